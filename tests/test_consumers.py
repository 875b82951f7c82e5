"""Topics kept in files, a consumer over them, rejected rows, and numbered changes."""

from __future__ import annotations

import json
import random
import zlib
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidewatch.sources import logs
from tidewatch.streaming import consumer as consumers
from tidewatch.streaming import jobs
from tidewatch.streaming.feed import ChangeFeed

T = datetime(2025, 3, 1, tzinfo=timezone.utc)
KEYED = "key string, value string, partition int, timestamp timestamp"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    logs.register(spark)


def append(spark, path, rows, **options):
    spark.createDataFrame(rows, KEYED).coalesce(1).write.format("topic_log").option("path", path).options(**options).mode("append").save()


def stream(spark, path, **options):
    return spark.readStream.format("topic_log").option("path", path).options(**options).load()


def minute(m):
    return T + timedelta(minutes=m)


def test_offsets_go_on_from_batch_to_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    append(spark, path, [("a", "1", 0, minute(1)), ("b", "2", 1, minute(2)), ("a", "3", 0, minute(3))])
    append(spark, path, [("a", "4", 0, minute(4)), ("c", None, 2, minute(5)), (None, "6", None, minute(6))], partitions=4)
    got = spark.read.format("topic_log").option("path", path).option("topic", "t").load().collect()
    value = lambda r: None if r.value is None else r.value.decode()
    assert sorted((r.topic, r.partition, r.offset, value(r) or "") for r in got) == [("t", 0, 0, "1"), ("t", 0, 1, "3"), ("t", 0, 2, "4"), ("t", 0, 3, "6"), ("t", 1, 0, "2"), ("t", 2, 0, "")]
    assert {r.timestamp.replace(tzinfo=timezone.utc) for r in got} <= {minute(m) for m in range(1, 7)}
    assert zlib.crc32(b"") % 4 == 0
    log = logs.Log(path)
    assert log.since(int(minute(3).timestamp() * 1e6)) == {0: 1, 1: 1, 2: 0}
    with pytest.raises(Exception, match="only added to"):
        spark.createDataFrame([], KEYED).write.format("topic_log").option("path", path).mode("overwrite").save()


def test_parts_of_a_segment(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"timestamp": pa.array(range(100), pa.timestamp("us", tz="UTC")), "key": [b"k"] * 100, "value": [str(i).encode() for i in range(100)]}), tmp_path / "s.parquet", row_group_size=7)
    log = logs.Log(str(tmp_path))
    for low, high in ((500, 600), (503, 521), (599, 600), (510, 510), (520, 521)):
        got = [(at + i, v) for at, b in log.read("s.parquet", 500, low, high, ["value"]) for i, v in enumerate(b.column(0).to_pylist())]
        assert got == [(o, str(o - 500).encode()) for o in range(low, high)]


def test_a_limit_is_shared_by_what_waits(tmp_path):
    (tmp_path / "_log").mkdir()
    (tmp_path / "_log" / f"{0:020d}.json").write_text(json.dumps([vars(logs.Segment(f"{p}", p, 0, n, 0, 0)) for p, n in ((0, 900), (1, 100), (2, 1))]))
    options = {"path": str(tmp_path), "limit": "100", "progress": str(tmp_path / "p")}
    reader, start, steps = logs.LogStreamReader(options), {}, 0
    while True:
        end = reader.latestOffset()
        took = sum(end.values()) - sum(start.values())
        assert took <= 100 and all(end[p] >= n for p, n in start.items())
        if not took:
            break
        pieces = reader.partitions({str(p): n for p, n in start.items()}, {str(p): n for p, n in end.items()})
        assert sum(x.high - x.low for x in pieces) == took
        start, steps = end, steps + 1
        if steps % 3 == 0:
            reader = logs.LogStreamReader(options)  # a restart
    assert start == {0: 900, 1: 100, 2: 1} and steps <= 13


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), tmp_path / "checkpoint"

    def run():
        rows = spark.readStream.schema("key string, value string").json(str(source))
        out = rows.writeStream.format("topic_log").option("path", path).option("partitions", "3").option("checkpointLocation", str(checkpoint))
        out.trigger(availableNow=True).start().awaitTermination()

    want = []
    source.mkdir()
    for n in range(3):
        rows = [{"key": f"k{i % 5}", "value": f"{n}.{i}"} for i in range(20)]
        want += [(r["key"].encode(), r["value"].encode()) for r in rows]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        run()
        # as if the stream had stopped before it noted that the batch was done
        (checkpoint / "commits" / str(n)).unlink()
        (checkpoint / "commits" / f".{n}.crc").unlink()
        run()
    got = spark.read.format("topic_log").option("path", path).load().collect()
    assert sorted((bytes(r.key), bytes(r.value)) for r in got) == sorted(want)
    assert all(r.partition == zlib.crc32(r.key) % 3 for r in got)
    for p in range(3):
        assert sorted(r.offset for r in got if r.partition == p) == list(range(sum(r.partition == p for r in got)))
    files = {f.name for f in Path(path).glob("*.parquet")}
    assert files == {s.file for s in logs.Log(path).segments()}  # what was written twice is gone


SCHEMA = "id int, name string"


def given(rng):
    """Messages of two partitions, some broken, with what should become of each."""
    rows, good, dead = [], [], []
    for p in (0, 1):
        for o in range(15):
            kind = rng.choice(("good", "good", "good", "json", "tombstone", "rule", "sink"))
            body = {"id": 100 * p + o, "name": {"rule": "", "sink": "poison"}.get(kind, "n")}
            value = {"json": "{", "tombstone": None}.get(kind, json.dumps(body))
            rows.append((f"k{o % 3}", value, p, minute(o)))
            if kind == "good":
                good.append((p, o, body["id"]))
            else:
                dead.append((p, o, {"rule": "name", "sink": "poison"}.get(kind, kind)))
    return rows, sorted(good), sorted(dead)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_message_once_over_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, good, dead = given(rng)
    path, sink = str(tmp_path / "log"), tmp_path / "sink"
    sink.mkdir()
    append(spark, path, rows[:20])

    def write(number):
        def put(group):
            if "poison" in group.column("name").to_pylist():
                raise consumers.DataError("poison")
            for r in group.to_pylist():
                (sink / f"{r['partition']}-{r['offset']}").write_text(f"{r['id']} {number}")

        return put

    failures = iter([True, False, True, True] + [False] * 99)
    handle = consumers.rejecting(write, str(tmp_path / "rejected"))

    def shaky(batch, number):
        rejected = handle(batch, number)
        if next(failures):
            raise consumers.Transient("later", 7.0)
        return rejected

    slept = []
    run = consumers.Consumer(SCHEMA, shaky, str(tmp_path / "dead"), F.when(F.col("row.name") == "", "name"), sleep=slept.append)
    for step in range(4):
        if step == 2:
            append(spark, path, rows[20:])
        options = {"limit": "6", "progress": str(tmp_path / "p")}
        q = run.start(stream(spark, path, **options), str(tmp_path / "c"), **({"availableNow": True} if step < 3 else {"processingTime": "0 seconds"}))
        q.awaitTermination() if step < 3 else q.processAllAvailable()
        q.stop()
    assert sorted((*map(int, f.name.split("-")), int(f.read_text().split()[0])) for f in sink.iterdir()) == good
    told = consumers.read_dead_letters(spark, str(tmp_path / "dead")).collect()
    assert sorted((r.partition, r.offset, r.error) for r in told) == dead
    by = {(p, sum(x[2] == p for x in rows[:i])): v for i, (_, v, p, _) in enumerate(rows)}
    for r in told:
        import base64

        assert (None if r.payload_b64 is None else base64.b64decode(r.payload_b64).decode()) == by[r.partition, r.offset]
    assert slept == [7.0, 7.0, 7.0] and run.waits == slept


def test_a_failing_batch_is_tried_so_often(spark, tmp_path):
    def never(batch, number):
        raise consumers.Transient("down")

    slept = []
    run = consumers.Consumer(SCHEMA, never, str(tmp_path / "dead"), tries=4, sleep=slept.append)
    batch = spark.createDataFrame([("t", 0, 0, None, bytearray(b"{}"))], "topic string, partition int, offset long, key binary, value binary")
    with pytest.raises(consumers.Transient):
        run(batch, 0)
    assert slept == [1.0, 2.0, 4.0] and consumers.read_dead_letters(spark, str(tmp_path / "dead")).count() == 0


def test_since_a_time(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    append(spark, path, [("k", str(m), m % 2, minute(m)) for m in (0, 1, 2, 3, 9, 5, 4, 7)] + [("k", "old", 2, minute(0))])
    q = stream(spark, path, since_ms=str(int(minute(4).timestamp() * 1000))).writeStream.foreachBatch(lambda b, n: seen.extend(b.collect()))
    q = q.option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    append(spark, path, [("k", "new", 2, minute(1))])
    q.processAllAvailable()
    q.stop()
    # from the first of that time on, later ones of an earlier time too
    assert sorted(r.value.decode() for r in seen) == ["4", "5", "7", "9", "new"]


def test_bad_rows_cost_as_many_writes_as_halves(spark):
    calls = spark.sparkContext.accumulator(0)

    def put(group):
        calls.add(1)
        if any(group.column("id")[i].as_py() in (77, 500) for i in range(group.num_rows)):
            raise consumers.DataError("bad id")

    rows = spark.range(1024).coalesce(1).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), "id")
    assert sorted(map(tuple, consumers.write_or_reject(rows, put).collect())) == [("t", 0, 77, "bad id"), ("t", 0, 500, "bad id")]
    assert calls.value <= 2 * 2 * 10 + 1
    assert consumers.write_or_reject(rows.limit(0), put).count() == 0


def test_numbers_without_gaps(spark, tmp_path):
    feed = ChangeFeed(str(tmp_path / "f"), ["k"])
    rng, n = random.Random(3), 0
    for number in (0, 1, 4):
        keys = rng.sample(range(1000), 0 if number == 1 else 300)
        df = spark.createDataFrame([(k, f"v{number}") for k in keys], "k int, v string").repartition(7)
        for _ in range(2):  # a batch that runs again
            assert feed.write(df, number) == (n, len(keys))
        n += len(keys)
    got = sorted(feed.read(spark).collect(), key=lambda r: r.change)
    assert [r.change for r in got] == list(range(600)) and [(r.batch, r.k) for r in got] == sorted((r.batch, r.k) for r in got)


def test_a_bucket_that_becomes_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, v string")
    table = jobs.BucketTable(str(tmp_path / "t"), ["k"], empty, 4)
    rows = spark.createDataFrame([(k, "x") for k in range(6)], "k int, v string")
    table.change(rows, 0, lambda old: old.unionByName(rows))
    gone = rows.where("k IN (1, 2, 3)")
    for _ in range(2):
        table.change(gone, 1, lambda old: old.join(gone.select("k"), "k", "left_anti"))
    assert sorted(r.k for r in table.read(spark).collect()) == [0, 4, 5]
    assert table.read(spark, before=1).count() == 6
    table.change(rows, 2, lambda old: old.where("false"))
    assert table.read(spark).count() == 0
    table.vacuum(spark, keep=1)
    assert table.read(spark).count() == 0
