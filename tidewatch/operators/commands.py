"""Small tables that commands change, and messages that go out once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subscribed(commands: DataFrame) -> DataFrame:
    """(chat_id, unit_key) after ``commands(chat_id, unit_key, command, seq)`` in order of seq.

    subscribe and unsubscribe set a unit, toggle turns it, and forget, whose unit is null, drops all
    that a chat had before. A toggle's outcome hangs on what came last before it that set the unit,
    and on how many toggles followed; both are counted, so that no unit's commands are gathered.
    """
    by = ["chat_id", "unit_key"]
    wiped = commands.where("command = 'forget'").groupBy("chat_id").agg(F.max("seq").alias("wiped"))
    own = commands.where("command <> 'forget'").join(wiped, "chat_id", "left")
    own = own.where(F.col("wiped").isNull() | (F.col("seq") > F.col("wiped"))).select(*by, "command", "seq")
    last = own.where("command <> 'toggle'").groupBy(*by).agg(F.max_by("command", "seq").alias("set_to"), F.max("seq").alias("at"))
    turns = own.where("command = 'toggle'").join(last, by, "left").where("at IS NULL OR seq > at").groupBy(*by).agg(F.count("*").alias("n"))
    states = last.select(*by, (F.col("set_to") == "subscribe").cast("long").alias("n")).unionAll(turns)
    return states.groupBy(*by).agg(F.sum("n").alias("n")).where("n % 2 = 1").select(*by)


def muted(commands: DataFrame) -> DataFrame:
    """(chat_id, post_id, muted_at) after ``commands(chat_id, post_id, command, seq, at)`` in order of seq.

    unmute takes a post off the list, mute puts it on it; one that is there already keeps its time.
    """
    by = ["chat_id", "post_id"]
    off = commands.where("command = 'unmute'").groupBy(*by).agg(F.max("seq").alias("off"))
    on = commands.where("command = 'mute'").join(off, by, "left").where("off IS NULL OR seq > off")
    return on.groupBy(*by).agg(F.min_by("at", "seq").alias("muted_at"))


def purged(muted: DataFrame, before: Column) -> DataFrame:
    """What is left of ``muted`` after all older than ``before`` is dropped; a row of that very time stays."""
    return muted.where(F.col("muted_at") >= before)


def preferences(toggles: DataFrame) -> DataFrame:
    """(chat_id, post_alerts, board_alerts) of chats with ``toggles(chat_id, unit_type)``: both kinds are on at first."""
    even = lambda kind: F.count_if(F.col("unit_type") == kind) % 2 == 0
    return toggles.groupBy("chat_id").agg(even("post").alias("post_alerts"), even("board").alias("board_alerts"))


def board_requests(requests: DataFrame, boards: DataFrame) -> DataFrame:
    """(request_id, board, status): 201 and 409 for requests to create boards, 200 and 404 for changes.

    ``requests(request_id, board, kind)`` come in order of request_id. A board is there if the
    table has it or an earlier request creates it.
    """
    told = requests.join(boards.select("board", F.lit(True).alias("there")), "board", "left")
    creates = F.when(F.col("kind") == "create", F.col("request_id"))
    first = F.min(creates).over(Window.partitionBy("board"))
    there = F.coalesce("there", F.lit(False)) | F.coalesce(first < F.col("request_id"), F.lit(False))
    create = F.col("kind") == "create"
    status = F.when(create, F.when(there, 409).otherwise(201)).otherwise(F.when(there, 200).otherwise(404))
    return told.select("request_id", "board", status.alias("status"))


def fan_out(alerts: DataFrame, recipients: DataFrame, sent: DataFrame, keys: Sequence[str] = ("alert_id", "chat_id")) -> DataFrame:
    """Messages to send: each alert once to each chat that wants it, but for what is sent already."""
    fresh = alerts.select("alert_id").distinct().join(recipients, "alert_id").select(*keys).distinct()
    return fresh.join(sent.select(*keys), list(keys), "left_anti")


def ranked_after_exclusion(df: DataFrame, by: str, order: Sequence[str], most: int, extra: int, excluded: DataFrame, key: str) -> DataFrame:
    """The first ``most`` rows by group that aren't excluded, of the first most + extra."""
    w = Window.partitionBy(by).orderBy(*order)
    some = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most + extra).join(excluded.select(key), key, "left_anti")
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("__r")
