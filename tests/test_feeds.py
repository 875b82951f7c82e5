"""Topics, checks before use, and classifiers inside tasks."""

from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewatch.operators import curation, inference
from tidewatch.sources import topics
from tidewatch.streaming import jobs

CLASSES = ("positive", "negative", "neutral")


def test_recording_streams_and_dead_letters_tell_where_they_lay(spark, tmp_path):
    code = lambda b: base64.b64encode(b).decode()
    values = [b'{"a":1}', b"{", None, b'{"a":"x"}', b'{"b":2}']
    lines = [{"topic": "t", "partition": 0, "offset": i, "timestamp_ms": 1000 * i, "key_b64": code(b"k"), "value_b64": None if v is None else code(v)} for i, v in enumerate(values)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = {"good": [], "bad": []}

    def take(batch, number):
        decoded = topics.decode_json(batch, "a int")
        got["good"] += topics.good(decoded).collect()
        got["bad"] += topics.dead_letters(decoded).collect()

    stream = topics.stream_recording(spark, str(tmp_path / "in"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.a or 0 for r in got["good"]) == [0, 1]
    assert sorted((r.offset, r.error, r.key_b64) for r in got["bad"]) == [(1, "json", code(b"k")), (2, "tombstone", code(b"k")), (3, "json", code(b"k"))]


def test_avro_needs_its_package(spark):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"], "default": None}]})
    framed = bytes(5) + bytes([2, 2 * 21])
    df = spark.createDataFrame([("t", 0, 0, b"k", framed), ("t", 0, 1, b"k", b"\x01"), ("t", 0, 2, b"k", None)], "topic string, partition int, offset long, key binary, value binary")
    try:
        got = topics.decode_avro(df, schema)
        rows = got.collect()
    except Exception as e:
        if "avro" not in str(e).lower():
            raise
        pytest.skip("Spark's Avro package isn't there")
    assert [(r.error, r.row and r.row.a) for r in rows] == [(None, 21), ("avro", None), ("tombstone", None)]


def test_a_stream_has_no_end(spark):
    with pytest.raises(ValueError):
        topics.read_topic(spark, "broker:9092", "t", until_ms=1)


def test_times_that_fall_back(spark):
    rows = [("t", 0, o, s) for o, s in enumerate([5, 20, 8, 31, 10, 40])] + [("t", 1, 0, 3)] + [("t", 2, o, 15) for o in range(3)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = topics.between_times(df, F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(30)))
    assert sorted((r.partition, r.offset) for r in got.collect()) == [(0, 1), (0, 2), (2, 0), (2, 1), (2, 2)]


def test_imports_are_whole_or_refused(spark):
    lines = spark.createDataFrame(
        [(1, 1, "a", "positive"), (1, 2, "b", "neutral"), (2, 1, "a", "positive"), (2, 2, "a", "negative"), (3, 1, "z", "neutral"), (4, 1, "a", "bad"), (4, 2, "a", "neutral"), (5, 1, "a", None)],
        "batch int, line int, post_id string, polarity string",
    )
    allowed = spark.createDataFrame([(b, p) for b in range(1, 6) for p in "ab"], "batch int, post_id string")
    got = curation.import_errors(lines, allowed, CLASSES)
    assert sorted((r.batch, r.line, r.error) for r in got.where("error IS NOT NULL").collect()) == [(2, 2, "twice"), (3, 1, "unknown"), (4, 1, "class"), (5, 1, "class")]
    assert sorted((r.batch, r.post_id) for r in curation.import_whole(got).collect()) == [(1, "a"), (1, "b")]


def test_quotas_are_filled_or_an_error(spark):
    rows = spark.createDataFrame([("x", i) for i in range(5)] + [("y", i) for i in range(2)], "board string, n int")
    assert sorted(map(tuple, curation.fill_quotas(rows, "board", {"x": 3, "y": 1}, ["n"]).collect())) == [("x", 0), ("x", 1), ("x", 2), ("y", 0)]
    with pytest.raises(ValueError, match="y: 2 of 3; z: 0 of 1"):
        curation.fill_quotas(rows, "board", {"x": 3, "y": 3, "z": 1}, ["n"])


def test_examples_with_faults_are_refused(spark):
    rows = spark.createDataFrame([("a", "positive")] * 2 + [("b", "negative")] * 2 + [("c", "neutral"), (" ", "neutral"), (None, "odd"), ("d", None)], "text string, polarity string")
    assert sorted(map(tuple, curation.example_faults(rows, CLASSES, 3).collect())) == [("blank", 2), ("few negative", 1), ("few neutral", 1), ("few positive", 1), ("unknown", 2)]
    with pytest.raises(ValueError):
        curation.checked_examples(rows, CLASSES)
    assert curation.example_faults(rows.where("false"), CLASSES, 0).count() == 0


def test_model_choice(spark):
    figures = [("a", "exact", 0.80, 40.0, 50.0, 900.0), ("a", "small", 0.79, 20.0, 50.0, 500.0), ("b", "exact", 0.795, 20.0, 61.0, 900.0), ("b", "small", 0.70, 5.0, 5.0, 100.0)]
    df = spark.createDataFrame(figures, "model string, kind string, f1 double, p50 double, slowest double, memory_mb double")
    picked = curation.pick_kinds(df)
    assert sorted((r.model, r.kind) for r in picked.collect()) == [("a", "small"), ("b", "exact")]
    chosen = lambda preferred: [(r.model, r.passes) for r in curation.choose_model(picked, preferred).collect()]
    assert chosen("a") == [("a", True)] and chosen("none") == [("b", False)]


def test_backfill_stops_at_the_limit_or_the_moment(spark):
    rows = [("long", f"p{i:04}", 100_000 - i) for i in range(50)] + [("short", f"q{i}", 100_000 - i) for i in range(7)]
    df = spark.createDataFrame(rows, "board string, post_id string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = curation.backfill_tasks(df, F.timestamp_seconds(F.lit(100_000 - 1000)), 5, 2, 6)
    assert sorted((r.board, r.task, r.first_page, r.last_page, r.goes_on) for r in got.collect()) == [
        ("long", 1, 1, 2, True), ("long", 2, 3, 4, True), ("long", 3, 5, 6, None), ("short", 1, 1, 2, False),
    ]
    near = curation.backfill_tasks(df, F.timestamp_seconds(F.lit(100_000 - 12)), 5, 2, 6).where("board = 'long'")
    assert sorted((r.task, r.last_page, r.goes_on) for r in near.collect()) == [(1, 2, True), (2, 3, False)]


def test_shares_of_all_classes_and_ties(spark):
    def load():
        return lambda texts: [{"positive": 0.5, "odd": 1.0} if t else {"neutral": 0.4, "negative": 0.4} for t in texts]

    df = spark.createDataFrame([("x",), (None,)], "text string").withColumn("s", inference.scores(load, CLASSES)("text"))
    got = {r.text: (r.s, r.top) for r in df.withColumn("top", inference.top_class(F.col("s"), CLASSES)).collect()}
    assert got["x"] == ({"positive": 0.5, "negative": 0.0, "neutral": 0.0}, "positive")
    assert got[None] == ({"positive": 0.0, "negative": 0.4, "neutral": 0.4}, "negative")


def test_session_batches_by_tokens():
    class Input:
        def __init__(self, name):
            self.name = name

    class Session:
        shapes = []

        def get_inputs(self):
            return [Input("input_ids"), Input("attention_mask")]

        def run(self, names, feeds):
            assert set(feeds) == {"input_ids", "attention_mask"}
            self.shapes.append(feeds["input_ids"].shape)
            n = (feeds["input_ids"] * feeds["attention_mask"]).sum(axis=1)
            return [np.stack([n, -n], axis=1) + 1e4]

    texts = ["aaaa", "", "a", "aaaaaaaaaa", "aa"]
    classify = inference.by_session(Session(), lambda t: [1] * len(t), ["p", "n"], max_len=6, max_tokens=8, pad=7)
    got = classify(texts)
    want = [1 / (1 + np.exp(-2 * min(6, len(t)))) for t in texts]
    assert [r["p"] for r in got] == pytest.approx(want)
    assert all(a * b <= 8 for a, b in Session.shapes) and sum(a for a, _ in Session.shapes) == 5
    with pytest.raises(ValueError):
        inference.by_session(Session(), list, ["p"], max_len=9, max_tokens=8)


def test_posts_are_inferred_once_and_alerts_kept_once(spark, tmp_path):
    empty = spark.createDataFrame([], "post_id string, text_hash string")
    known = jobs.BucketTable(str(tmp_path / "known"), ["post_id"], empty, 4)
    told = {}
    run = jobs.infer_posts(known, F.length, lambda df, n: told.__setitem__(n, sorted((r.post_id, r.scores) for r in df.collect())))
    batch = lambda rows: spark.createDataFrame(rows, "post_id string, text string, op string, is_deleted boolean, seq long")
    first = batch([("a", "x", "c", False, 1), ("a", "xy", "u", False, 2), ("b", "q", "u", False, 3), ("d", "q", "c", True, 4), ("e", None, "c", False, 5)])
    run(first, 0)
    assert told[0] == [("a", 2), ("e", 0)]
    run(first, 0)
    assert told[0] == [("a", 2), ("e", 0)]
    run(batch([("a", "xy", "u", False, 6), ("b", "qrs", "u", False, 7), ("d", "q", "u", False, 8)]), 1)
    assert told[1] == [("b", 3)]
    alerts = jobs.BucketTable(str(tmp_path / "alerts"), ["alert_id"], spark.createDataFrame([], "alert_id string, value int"), 4)
    keep = jobs.append_once(alerts)
    rows = lambda *r: spark.createDataFrame(list(r), "alert_id string, value int")
    keep(rows(("1", 5), ("1", 5), ("2", 6)), 0)
    keep(rows(("2", 6), ("3", 7)), 1)
    keep(rows(("2", 6), ("3", 7)), 1)
    assert sorted(map(tuple, alerts.read(spark).collect())) == [("1", 5), ("2", 6), ("3", 7)]
