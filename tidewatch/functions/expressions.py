"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOM = "爆"


def in_boards(board: Column, chosen: str) -> Column:
    """Is the board in a multi-select value such as ``{a,b}``, percent-encoded."""
    return F.array_contains(F.split(F.trim(F.url_decode(F.lit(chosen)), F.lit("{}")), ","), board)


def share(part: Column, total: Column) -> Column:
    return part.cast("double") / total.cast("double")


def controversy(push: Column, boo: Column, least: int = 10) -> Column:
    """boo / (push + boo), null for fewer votes than ``least``."""
    return F.when(push + boo >= least, share(boo, push + boo))


def allowed_url(url: Column, prefix: str) -> Column:
    """The URL if it starts with the site's prefix, else an empty string."""
    return F.when(url.startswith(prefix), url).otherwise(F.lit(""))


def csv_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would take as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def base64(data: Column | str) -> Column:
    """In one line, whatever the session breaks base64 into."""
    return F.translate(F.base64(data), "\r\n", "")


def sentiment_bucket(polarity: Column, score: Column, least: float) -> Column:
    return F.when(polarity.isNull(), "none").when(score < least, "uncertain").otherwise(polarity)


def list_push(text: Column) -> Column:
    """The push count of a list entry: empty 0, a number, the boom sign 100, XX -100, Xn -10n, else null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(t == "", F.lit(0))
        .when(t.rlike("^[0-9]+$"), t.try_cast("int"))
        .when(t == BOOM, F.lit(100))
        .when(t == "XX", F.lit(-100))
        .when(t.rlike("^X[0-9]$"), F.substring(t, 2, 1).try_cast("int") * -10)
    )


def post_text(title: Column, content: Column, most: int) -> Column:
    """Title and content, stripped of white space, the content cut to so many code points, as one text."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    cut = F.substring(strip(content), 1, most)
    return strip(F.concat(strip(title), F.lit("\n"), cut))


def article_time(text: Column, zone: str = "Asia/Taipei") -> Column:
    """``Sat Feb 03 08:09:10 2024`` in a zone as an instant, null if it isn't a time."""
    p = F.regexp_extract
    form = r"^\w{3}\s+(\w{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(\d{4})$"
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    month = F.array_position(F.array(*map(F.lit, months)), p(text, form, 1)).cast("int")
    num = lambda i: p(text, form, i).try_cast("int")
    local = F.try_make_timestamp_ntz(num(6), month, num(2), num(3), num(4), num(5).cast("decimal(16,6)"))
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


#: A time may lie so far after it was seen, for clocks that differ.
FUTURE_US = 86_400_000_000


def comment_time(text: Column, posted: Column, seen: Column | None = None, zone: str = "Asia/Taipei") -> Column:
    """``MM/DD HH:MM`` at the end of a text as an instant not before the post's month; null if invalid.

    The year is the post's local year, or the next one if the month is before the post's. A time
    more than a day after ``seen`` goes back to the post's year if it had the next one, and is null
    if that doesn't help.
    """
    form = r"(\d{2})/(\d{2}) (\d{2}):(\d{2})\s*$"
    num = lambda i: F.regexp_extract(text, form, i).try_cast("int")
    at = F.from_utc_timestamp(posted, zone)

    def instant(year: Column) -> Column:
        local = F.try_make_timestamp_ntz(year, num(1), num(2), num(3), num(4), F.lit(0).cast("decimal(16,6)"))
        return F.to_utc_timestamp(local.cast("timestamp"), zone)

    later = num(1) < F.month(at)
    first = instant(F.year(at) + F.when(later, 1).otherwise(0))
    if seen is None:
        return first
    fits = lambda c: F.unix_micros(c) <= F.unix_micros(seen) + FUTURE_US
    same = instant(F.year(at))
    return F.when(fits(first), first).when(later & fits(same), same)


def number_or(text: Column, default: float) -> Column:
    """A text as a double, the default if it isn't one."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def some_time(text: Column) -> Column:
    """An instant written in any of the usual ways, null if in none of them."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def zoned_time(text: Column) -> Column:
    """An ISO instant with its offset; null without one, as its zone would be a guess."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def pairing_key(author: Column, text: Column) -> Column:
    """What the same remark has in two feeds: its author and a digest of its text, white space made even."""
    even = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " "))
    return F.concat_ws("|", author, F.substring(F.sha1(even), 1, 16))


def local_day(at: Column, zone: str = "Asia/Taipei") -> Column:
    """The instant at which the local day of an instant began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at, zone)), zone)


def next_crawl(created: Column, now: Column) -> Column:
    """When a post is due again by its age; null once it is a day old."""
    age = F.unix_micros(now) - F.unix_micros(created)
    minute = 60_000_000
    wait = F.when(age < 60 * minute, 5 * minute).when(age < 360 * minute, 10 * minute).when(age < 1440 * minute, 60 * minute)
    return F.timestamp_micros(F.unix_micros(now) + wait)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """A version 5 UUID of a name, made of its SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    tail = F.concat(variant, part(18, 3))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), tail, part(21, 12))
