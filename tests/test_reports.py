"""Commands on small tables, and reports, with numbers of their own."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import commands, reports


def test_subscribed_counts_toggles_after_the_last_setting(spark):
    log = [(1, "x", "toggle", 1), (1, "y", "subscribe", 2), (1, "y", "toggle", 3), (1, "z", "toggle", 4), (1, "z", "unsubscribe", 5), (1, "z", "toggle", 6)]
    log += [(2, "x", "subscribe", 1), (2, None, "forget", 2), (2, "y", "toggle", 3), (2, "y", "toggle", 4), (3, "x", "subscribe", 1), (3, "x", "subscribe", 2)]
    got = commands.subscribed(spark.createDataFrame(log, "chat_id long, unit_key string, command string, seq long")).collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (1, "z"), (3, "x")]


def test_muted_keeps_the_first_time_and_is_purged(spark):
    day = lambda d: datetime(2031, 5, d)
    log = [(1, "p", "mute", 1, day(2)), (1, "p", "mute", 2, day(9)), (1, "q", "mute", 3, day(3)), (1, "q", "unmute", 4, day(4)), (1, "q", "mute", 5, day(6))]
    log += [(2, "p", "mute", 1, day(7)), (2, "p", "unmute", 2, day(8)), (3, "r", "unmute", 1, day(1))]
    told = commands.muted(spark.createDataFrame(log, "chat_id long, post_id string, command string, seq long, at timestamp"))
    assert sorted(map(tuple, told.collect())) == [(1, "p", day(2)), (1, "q", day(6))]
    assert [r.post_id for r in commands.purged(told, F.lit(day(6))).collect()] == ["q"]
    assert commands.purged(told, F.lit(day(7))).count() == 0


def test_preferences(spark):
    log = [(1, "post"), (1, "board"), (1, "post"), (2, "board")]
    got = commands.preferences(spark.createDataFrame(log, "chat_id long, unit_type string")).collect()
    assert sorted(map(tuple, got)) == [(1, True, False), (2, True, False)]


PAIRS = "board string, polarity_a string, score_a double, polarity_b string, score_b double, label string"
ROWS = [("x", "positive", 0.9, "positive", 0.8, "positive"), ("x", "negative", 0.45, "positive", 0.65, "negative"), ("y", "neutral", 0.5, "neutral", 0.55, None), ("y", "negative", 0.95, "negative", 0.3, "negative")]


def numbers(report):
    rows = reports.stacked(report).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): r.value for r in rows}


def test_reports(spark):
    pairs = spark.createDataFrame(ROWS, PAIRS)
    latency = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 1.0)], "model string, latency_s double")
    report = reports.comparison(pairs, latency)
    got = numbers(report)
    assert got["agreement", "all", "accuracy"] == 0.75 and got["agreement", "x", "accuracy"] == 0.5 and got["agreement", "y", "n"] == 2
    assert got["confusion", "x/negative/positive", "n"] == 1 and got["confusion", "all/negative/negative", "n"] == 1
    assert got["latency", "a", "p50"] == 5 and got["latency", "b", "max"] == 1
    assert got["confidence", "a/0.5", "below"] == 0.25 and got["confidence", "b/0.7", "accuracy"] == 1
    assert got["labels", "a", "n"] == 3 and got["labels", "a", "accuracy"] == 1 and got["f1", "b", "f1_negative"] == 2 / 3
    shown = reports.text("a and b", report)
    assert shown.startswith("# a and b") and shown.count("## ") == 6 and "| all | 4 | 0.750 |" in shown
    one = reports.evaluation(pairs, "polarity_b", spark.createDataFrame([("neutral", "neutral"), ("neutral", "positive")], "first string, second string"), small=2)
    got = numbers(one)
    assert got["posts", "y", "few"] == 1 and got["posts", "x", "few"] == 0 and got["annotators", "all", "accuracy"] == 0.5
    assert got["confusion", "negative/positive", "n"] == 1 and got["f1", "x", "f1_positive"] == 2 / 3


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], PAIRS)
    got = numbers(reports.comparison(none, spark.createDataFrame([], "model string, latency_s double")))
    assert got["agreement", "all", "n"] == 0 and got["f1", "a", "macro_f1"] == 0 and not any(k[0] == "latency" for k in got)
    assert numbers(reports.push_ratio(spark.createDataFrame([], "board string, polarity string, level int, ratio double"))) == {}
