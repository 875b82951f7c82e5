"""Known values of scalar expressions, statistics and page readers."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewatch.functions import expressions as X
from tidewatch.functions import stats
from tidewatch.functions.parsing import read_post


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(text):
    return F.lit(text).cast("string")


def test_list_push_follows_its_rule(spark):
    """Counts as numbers, a full one as 100, X and a digit as that many tens below 0; anything else is unknown."""
    for n in (0, 3, 47, 99):
        for text in (str(n), f"  {n}", f"{n}\t"):
            assert value(spark, X.list_push(lit(text))) == n
    assert [value(spark, X.list_push(lit(f"X{d}"))) for d in range(1, 10)] == [-10 * d for d in range(1, 10)]
    full, below = "爆", "XX"  # fixed values: what a list shows at either end
    assert value(spark, X.list_push(lit(full))) == 100 and value(spark, X.list_push(lit(below))) == -100
    assert value(spark, X.list_push(lit("  "))) == 0
    for odd in ("seven", "X1X", "Y4", "4e1", "爆2", None):
        assert value(spark, X.list_push(lit(odd))) is None


def shown(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def test_article_time_reads_what_the_clock_wrote(spark):
    """Times are written eight hours ahead of UTC, the day of the month with or without a blank or nought before it."""
    for at in (datetime(2025, 2, 3, 23, 5, 9), datetime(2024, 2, 29, 0, 0, 0), datetime(2023, 12, 31, 6, 30, 1)):
        for day in (f"{at.day:2d}", f"{at.day:02d}"):
            text = at.strftime(f"%a %b {day} %H:%M:%S %Y")
            got = value(spark, shown(X.article_time(lit(text))))
            assert got == (at - timedelta(hours=8)).strftime("%Y-%m-%d %H:%M:%S")
    for odd in ("no time at all", "Mon Xyz 03 23:05:09 2025", "Mon Feb 03 23:65:09 2025", "Mon Feb 03 23:05:09", " ", None):
        assert value(spark, X.article_time(lit(odd))) is None


def test_comment_time_takes_the_year_from_its_post(spark):
    """A month before the post's own is the next year's; the address before a time is left out."""
    for posted, said in (
        (datetime(2025, 5, 20, 9, 0), datetime(2025, 5, 20, 9, 45)), (datetime(2025, 5, 20, 9, 0), datetime(2025, 7, 1, 0, 1)),
        (datetime(2025, 11, 30, 20, 0), datetime(2026, 2, 2, 2, 2)), (datetime(2023, 12, 31, 23, 50), datetime(2024, 1, 1, 0, 10)),
    ):
        for before in ("", "198.51.100.77 "):
            post_utc = (posted - timedelta(hours=8)).strftime("%Y-%m-%d %H:%M:%S")
            got = X.comment_time(lit(before + said.strftime("%m/%d %H:%M")), lit(post_utc).cast("timestamp"))
            assert value(spark, shown(got)) == (said - timedelta(hours=8)).strftime("%Y-%m-%d %H:%M:%S")
    for odd in ("198.51.100.77", "13/05 10:10", "04/31 10:10", "noon", " ", None):
        assert value(spark, shown(X.comment_time(lit(odd), lit("2025-05-20 01:00:00").cast("timestamp")))) is None


def test_comment_time_isnt_in_the_future(spark):
    """More than a day after it was seen a time is the year before's if a year was added, else unknown."""
    at = lambda text: lit(text).cast("timestamp")
    told = lambda text, posted, seen: value(spark, shown(X.comment_time(lit(text), at(posted), at(seen))))
    assert told("03/10 08:30", "2025-03-09 00:00:00", "2025-03-09 23:00:00") == "2025-03-10 00:30:00"
    assert told("03/11 08:30", "2025-03-09 00:00:00", "2025-03-09 23:00:00") is None
    # the post is edited after the year's end: its month is later than the comment's, which is this year's
    assert told("02/01 08:30", "2025-04-01 00:00:00", "2025-04-02 00:00:00") == "2025-02-01 00:30:00"
    assert told("02/01 08:30", "2024-12-01 00:00:00", "2025-02-02 00:00:00") == "2025-02-01 00:30:00"


@pytest.mark.parametrize(("minutes", "wait"), [(59, 5), (60, 10), (359, 10), (360, 60), (1439, 60), (1440, None)])
def test_next_crawl(spark, minutes, wait):
    now = lit("2026-10-07 12:00:00").cast("timestamp")
    created = F.timestamp_micros(F.unix_micros(now) - minutes * 60_000_000)
    got = value(spark, (F.unix_micros(X.next_crawl(created, now)) - F.unix_micros(now)) / 60_000_000)
    assert got == wait


def test_uuid5(spark):
    ns = uuid.UUID("6f1f0b8e-6c55-4c1e-9a43-2d7f1b0c9a51")
    for name in ("post|a|2026", "board|é|", ""):
        assert value(spark, X.uuid5(ns.hex, lit(name))) == str(uuid.uuid5(ns, name))


def test_small_expressions(spark):
    assert value(spark, X.csv_safe(lit("=1+1"))) == "'=1+1" and value(spark, X.csv_safe(lit("a=1"))) == "a=1"
    assert value(spark, X.in_boards(lit("b"), "%7Ba%2Cb%7D")) is True and value(spark, X.in_boards(lit("c"), "{a,b}")) is False
    assert value(spark, X.controversy(F.lit(5), F.lit(5))) == 0.5 and value(spark, X.controversy(F.lit(5), F.lit(4))) is None
    assert value(spark, X.post_text(lit("　title\n"), lit(" body text "), 4)) == "title\nbody"
    assert value(spark, X.post_text(lit(None), lit(None), 4)) == ""
    assert value(spark, X.sentiment_bucket(lit("positive"), F.lit(0.4), 0.5)) == "uncertain"


def test_agreement_edges(spark):
    pairs = "a string, b string"
    none = stats.agreement(spark.createDataFrame([], pairs), "a", "b").first()
    assert (none.n, none.accuracy, none.kappa) == (0, 0.0, 0.0)
    one = stats.agreement(spark.createDataFrame([("neutral", "neutral")] * 4, pairs), "a", "b").first()
    assert (one.accuracy, one.kappa) == (1.0, 1.0)


def test_known_comparison(spark):
    made = [("x", a, b) for a, b in [("positive", "positive"), ("negative", "positive"), ("neutral", "neutral"), ("neutral", "negative")]]
    got = stats.agreement(spark.createDataFrame(made, "board string, a string, b string"), "a", "b", ["board"]).first()
    assert got.n == 4 and got.accuracy == 0.5 and got.kappa == pytest.approx((4 * 2 - 5) / (16 - 5))
    f1 = stats.f1_scores(spark.createDataFrame(made, "board string, a string, b string"), "a", "b").first()
    assert (f1.f1_positive, f1.f1_negative, f1.f1_neutral) == (pytest.approx(2 / 3), 0.0, pytest.approx(2 / 3))


def test_confidence_buckets(spark):
    rng = random.Random(4)
    made = [(rng.random(), rng.choice((True, False, None))) for _ in range(60)]
    df, cuts = spark.createDataFrame(made, "s double, r boolean"), (0.25, 0.5, 0.8, 1.5)
    for r in stats.confidence_buckets(df, "s", "r", cuts).collect():
        known = [ok for s, ok in made if s >= r.threshold and ok is not None]
        assert r.below == pytest.approx(sum(s < r.threshold for s, _ in made) / 60) and r.n == len(known)
        assert r.accuracy == (pytest.approx(sum(known) / len(known)) if known else None)
    none = stats.confidence_buckets(df.where("false"), "s", "r", cuts).collect()
    assert [tuple(r) for r in none] == [(c, 0.0, 0, None) for c in cuts]


def test_percentiles_and_ranks(spark):
    df = spark.range(1, 22).withColumn("x", F.col("id").cast("double")).withColumn("g", F.lit(1))
    assert df.agg(stats.interpolated("x", 0.5)).first()[0] == 11.0 and df.agg(stats.interpolated("x", 0.95)).first()[0] == 20.0
    assert df.where("false").agg(stats.interpolated("x", 0.5)).first()[0] == 0.0
    assert stats.upper_median(df.where("id <= 4"), "x", ["g"]).first().upper_median == 3.0
    one = spark.createDataFrame([("a", 1.0, 1)], "g string, x double, y int")
    assert stats.spearman(one, "x", "y", ["g"]).first().rho is None
    flat = spark.createDataFrame([("a", float(i), 1) for i in range(5)], "g string, x double, y int")
    assert stats.spearman(flat, "x", "y", ["g"]).first().rho is None
    up = spark.createDataFrame([("a", float(i * i), i) for i in range(5)], "g string, x double, y int")
    assert stats.spearman(up, "x", "y", ["g"]).first().rho == pytest.approx(1.0)


def test_post_page():
    meta = "".join(f'<div class="article-metaline"><span class="article-meta-tag">{k}</span><span class="article-meta-value">{v}</span></div>' for k, v in [("作者", "someone (nick)"), ("標題", "[x] title"), ("時間", "Sat Feb 03 08:09:10 2024")])
    push = '<div class="push"><span class="push-tag">{} </span><span class="push-userid">u{}</span><span class="push-content">: hi</span><span class="push-ipdatetime">02/03 09:20\n</span></div>'
    page = f'<div id="main-content" class="bbs-screen main-content">{meta}body\nline\n--\nsignature' + push.format("推", 1) + push.format("噓", 2) + push.format("→", 3) + "</div>"
    got = read_post(page)
    assert (got["author"], got["title"], got["body"]) == ("someone", "[x] title", "body\nline")
    assert [c[:4] for c in got["comments"]] == [(1, "push", "u1", "hi"), (2, "boo", "u2", "hi"), (3, "arrow", "u3", "hi")]
    assert read_post(None)["comments"] == []


def test_list_page():
    from tidewatch.functions.parsing import read_list

    entry = '<div class="r-ent"><div class="nrec"><span>{}</span></div><div class="title">{}</div><div class="meta"><div class="author">{}</div></div></div>'
    page = '<div class="btn-group btn-group-paging"><a href="/old">最舊</a><a href="/before">‹ 上頁</a></div><div class="r-list-container">' + entry.format("爆", '<a href="/p1">one</a>', "x") + entry.format("", "(gone)", "-") + '<div class="r-list-sep"></div>' + entry.format("1", '<a href="/pin">pinned</a>', "y") + "</div>"
    got = read_list(page)
    assert got == {"entries": [("/p1", "one", "x", "爆", False), (None, "(gone)", None, "", True)], "before": "/before"}
    assert read_list("<p>are you 18</p>") is None and read_list(None) is None
