"""Stateful operators driven by hand, with a clock of the test's own, and as streams."""

from __future__ import annotations

import random
import time
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidewatch.operators import heat, inference
from tidewatch.sources import logs
from tidewatch.streaming import counters, fetches, jobs, notify
from tidewatch.streaming.consumer import Transient


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Map:
    def __init__(self):
        self.rows, self.writes = {}, 0

    def iterator(self):
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value
        self.writes += 1

    def removeKey(self, key):  # noqa: N802
        del self.rows[key]


class Handle:
    """The state of one key, and its timers."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):  # noqa: N802
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.ms


def told(frames):
    return [tuple(r) for f in frames for r in f.itertuples(index=False)]


def run_until(query, done, seconds=60):
    """Streams with timers by the clock have no last batch, so that nothing waits for it."""
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.3)
    query.stop()
    assert done()


RULES = heat.SurgeRules(window=4, warmup=5, longest_gap=50, least_board=12, least_post=8, least_z=1.0, quiet=6)


def comments(rng, n, start=1000):
    rows, minute = [], start
    for lsn in range(n):
        minute += rng.random() < (0.02 if n // 2 < lsn < n // 2 + 150 else 0.3)
        rows.append((f"p{rng.randrange(5)}", minute - rng.choice((0, 0, 0, 1, 2, 3, 9)), lsn))
    return rows


def frames(rows, rng):
    rows = list(rows)
    rng.shuffle(rows)
    return [pd.DataFrame(rows[i : i + 37], columns=["post_id", "minute", "lsn"]) for i in range(0, len(rows), 37)]


def test_keyed_state_gives_what_a_plain_fold_gives():
    rng = random.Random(5)
    rows = comments(rng, 1200)
    board = heat.Board()
    want = [("b", *t) for p, m, _ in rows for t in board.take("b", p, m, m, RULES)]
    assert len(want) > 2
    for cuts in ([], [600], [1, 2, 50, 51, 640, 641, 1100]):
        handle, got = Handle(), []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            processor = heat.HeatProcessor(RULES)  # a new one a batch, as after a restart
            processor.init(handle)
            got += told(processor.handleInputRows(("b",), iter(frames(rows[a:b], rng)), Clock(0)))
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        kept = {k[0] for k in handle.states["counts"].rows}
        assert min(kept) > max(m for _, m, _ in rows) - RULES.window - RULES.grace - 2  # the rest is evicted


def test_a_batch_writes_what_it_counts_only():
    rng, handle = random.Random(6), Handle()
    processor = heat.HeatProcessor(RULES)
    processor.init(handle)
    many = [(f"p{i}", 1000 + i % 2, i) for i in range(5000)]
    told(processor.handleInputRows(("b",), iter(frames(many, rng)), Clock(0)))
    counts = handle.states["counts"]
    assert counts.writes == 5000
    told(processor.handleInputRows(("b",), iter(frames([("p1", 1001, 9000), ("p1", 1001, 9001), ("q", 1001, 9002)], rng)), Clock(0)))
    assert counts.writes == 5002


def test_catching_up_raises_nothing_live():
    rng = random.Random(7)
    rows = comments(rng, 1200)
    last = max(m for _, m, _ in rows)

    rules = replace(RULES, stale_after=900)

    def alerts(now, live=True):
        processor = heat.HeatProcessor(rules, live)
        processor.init(Handle())
        return told(processor.handleInputRows(("b",), iter(frames(rows, rng)), Clock(now * 60_000)))

    assert alerts(last + 10_000) == [] and alerts(last) == alerts(0, live=False) != []


def test_live_stream_runs(spark, tmp_path):
    rows = jobs.surge("2023-05-14 21:30:00", "a", 1, 60, 9, spark)
    rows.write.parquet(str(tmp_path / "in"))
    config = heat.SurgeRules(warmup=2, least_board=30, least_post=30, least_z=0.0)
    q = jobs.alert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), config, live=True)
    seen, numbers = [], []
    out = q.writeStream.foreachBatch(lambda b, n: (seen.extend(b.collect()), numbers.append(n))).option("checkpointLocation", str(tmp_path / "c"))
    run_until(out.trigger(processingTime="1 second").start(), lambda: len(numbers) > 1)
    assert seen == [] and heat.detect(rows, config).count() > 0  # long past


# fetches

FETCH = fetches.FetchRules(polls=3, attempts=5, first_wait_ms=100, longest_wait_ms=350)


def fetch_run(steps, rules=FETCH):
    """Decisions of (ms, kind, outcome) steps; timers that are due fire before a step."""
    handle, out, seq = Handle(), [], 0
    processor = fetches.FetchProcessor(rules)
    processor.init(handle)
    for ms, kind, outcome in [*steps, (10**9, None, None)]:
        for due in sorted(t for t in handle.timers if t <= ms):
            handle.timers.discard(due)
            out += [(due, *r[1:3]) for r in told(processor.handleExpiredTimer(("u",), Clock(due), Clock(due)))]
        if kind:
            seq += 1
            rows = pd.DataFrame([(seq, kind, outcome)], columns=["seq", "kind", "outcome"])
            out += [(ms, *r[1:3]) for r in told(processor.handleInputRows(("u",), iter([rows]), Clock(ms)))]
    return out


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([(0, "post", "ok")], [(0, "done", 1)]),
        ([(0, "post", "transient"), (150, "post", "ok")], [(100, "retry", 1), (150, "done", 2)]),
        # the wait doubles up to its limit, and the fifth failure is the last
        ([(t, "post", "transient") for t in (0, 200, 500, 1000, 2000)], [(100, "retry", 1), (400, "retry", 2), (850, "retry", 3), (1350, "retry", 4), (2000, "give_up", 5)]),
        # a success before the timer leaves none
        ([(0, "post", "transient"), (50, "post", "ok")], [(50, "done", 2)]),
        # a later failure replaces the timer
        ([(0, "post", "transient"), (50, "post", "transient")], [(250, "retry", 2)]),
        ([(0, "list", "failed"), (10, "list", "failed"), (20, "list", "failed"), (30, "list", "failed")], [(0, "next_poll", 1), (10, "next_poll", 2), (20, "give_up", 3), (30, "next_poll", 1)]),
        ([(0, "list", "failed"), (10, "list", "ok"), (20, "list", "failed")], [(0, "next_poll", 1), (10, "done", 2), (20, "next_poll", 1)]),
        ([(0, "post", "failed")], [(0, "give_up", 1)]),
    ],
)
def test_fetches_by_a_driven_clock(steps, want):
    assert fetch_run(steps) == want


def test_fetch_stream_fires_its_timers(spark, tmp_path):
    schema = "url string, kind string, outcome string, seq long"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "post", "transient", 1), ("b", "post", "ok", 2)], schema).coalesce(1).write.parquet(source)
    got = []
    rules = fetches.FetchRules(first_wait_ms=10)
    stream = fetches.decisions(spark.readStream.schema(schema).parquet(source), rules)
    q = stream.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    spark.createDataFrame([("c", "list", "failed", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run_until(q, lambda: len(got) >= 3)
    assert sorted((r.url, r.decision) for r in got) == [("a", "retry"), ("b", "done"), ("c", "next_poll")]


def plain_streaks(rows, most):
    out, failures = [], {}
    for site, seq, failed in sorted(rows, key=lambda r: r[1]):
        n = failures.get(site, 0)
        if failed:
            n += 1
            if n == most:
                out.append((site, seq, "unreachable", n))
        else:
            if n >= most:
                out.append((site, seq, "recovered", n))
            n = 0
        failures[site] = n
    return sorted(out)


def test_streaks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fetches, "STRETCH", 7)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, rng.random() < 0.8) for i in range(300)] + [("c", 1000 + i, True) for i in range(30)]
    schema = "site string, seq long, failed boolean"
    want = plain_streaks(rows, 4)
    assert sorted(map(tuple, fetches.streaks(spark.createDataFrame(rows, schema), 4).collect())) == want and len(want) > 9
    for a, b in ((0, 90), (90, 97), (97, 400)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = fetches.streak_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4)
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


# counters

T = datetime(2025, 6, 1, tzinfo=timezone.utc)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    schema = "board string, changed_at timestamp"
    source, closed, changed = str(tmp_path / "in"), [], []
    batches = [[("a", 0), ("a", 3), ("b", 7)], [("a", 16)], [("a", 4), ("b", 17)], [("a", 60)], [("a", 61)]]

    def counted():
        return counters.sliding_counters(spark.readStream.schema(schema).parquet(source), ["board"], width="10 minutes", step="5 minutes", delay="5 minutes")

    spark.createDataFrame([], schema).write.parquet(source)
    queries = [
        counted().writeStream.outputMode(mode).foreachBatch(lambda b, n, to=to: to.extend(b.collect())).option("checkpointLocation", str(tmp_path / mode)).start()
        for mode, to in (("append", closed), ("update", changed))
    ]
    for rows in batches:
        made = [(b, T + timedelta(minutes=m)) for b, m in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        for q in queries:
            q.processAllAvailable()
    late = [counters.left_out(q) for q in queries]
    for q in queries:
        q.stop()
    minutes = lambda r: int((r.start.replace(tzinfo=timezone.utc) - T).total_seconds() // 60)
    # ("a", 4) comes when the newest minute is 16: windows that ended by minute 11 are done, two of them would have counted it
    assert sorted((r.board, minutes(r), r.n) for r in closed) == [("a", -5, 2), ("a", 0, 2), ("a", 10, 1), ("a", 15, 1), ("b", 0, 1), ("b", 5, 1), ("b", 10, 1), ("b", 15, 1)]
    last = {}
    for r in changed:
        last[r.board, minutes(r)] = r.n
    assert last == {("a", -5): 2, ("a", 0): 2, ("b", 0): 1, ("b", 5): 1, ("a", 10): 1, ("a", 15): 1, ("b", 10): 1, ("b", 15): 1, ("a", 55): 2, ("a", 60): 2}
    assert late == [2, 2]


# messages

ALERT = "alert_id string, unit_type string, unit_key string, board string, created_at timestamp"


def test_each_message_once_over_retries_and_restarts(spark, tmp_path):
    logs.register(spark)
    subscriptions = spark.createDataFrame([(c, "board", "x") for c in range(1, 7)] + [(9, "board", "y")], "chat_id long, unit_type string, unit_key string")
    settings = spark.createDataFrame([(1, False, True), (2, True, False)], "chat_id long, post_alerts boolean, board_alerts boolean")
    muted = spark.createDataFrame([(3, "x.1")], "chat_id long, post_id string")
    wanted = lambda a: notify.recipients(a, subscriptions, settings, muted)
    sent, forgotten = spark.sparkContext.accumulator(0), []
    box = tmp_path / "box"
    box.mkdir()

    def send(rows, attempt):
        out = []
        for r in rows:
            kind = "again" if r["chat_id"] == 4 and attempt < 2 else "forbidden" if r["chat_id"] == 5 else "refused" if r["chat_id"] == 6 else "sent"
            if kind != "again":
                sent.add(1)
                with open(box / f"{r['alert_id']}-{r['chat_id']}", "a") as f:
                    f.write("x")
            out.append(kind)
        return out

    log = jobs.BucketTable(str(tmp_path / "log"), notify.KEYS, spark.createDataFrame([], notify.SENT), 4)
    sender = notify.Sender(log, str(tmp_path / "attempts"), send, lambda chats: forgotten.extend(r.chat_id for r in chats.collect()))
    source = str(tmp_path / "in")
    parts = [[("p1", "post", "x.1", "x", 0), ("b1", "board", "x", "x", 1)], [("p1", "post", "x.1", "x", 2), ("b2", "board", "y", "y", 3)], [("b1", "board", "x", "x", 500), ("b3", "board", "z", "z", 501)]]
    for rows in parts:
        made = [(*r[:4], T + timedelta(minutes=r[4])) for r in rows]
        spark.createDataFrame(made, ALERT).coalesce(1).write.mode("append").parquet(source)

        def start(run):
            stream = spark.readStream.schema(ALERT).parquet(source)
            out = notify.messages(stream, wanted, "30 minutes").writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c"))
            out.trigger(availableNow=True).start().awaitTermination()

        try:
            start(sender)  # fails on chat 4, as the query is tried once
        except Exception as e:
            assert "weren't sent" in str(e)
        slept = []
        start(notify.retried(sender, 3, slept.append))
    posts, boards = {2, 3, 4, 5, 6} - {3}, {1, 3, 4, 5, 6}
    want = {("p1", c) for c in posts} | {("b1", c) for c in boards} | {("b2", 9)}
    kind = {5: "forbidden", 6: "refused"}
    assert sorted(map(tuple, log.read(spark).collect())) == sorted((a, c, kind.get(c, "sent")) for a, c in want)
    assert sent.value >= len(want) and all(f.read_text() == "x" for f in box.iterdir()) and len(list(box.iterdir())) == len(want)
    assert set(forgotten) == {5}


def test_retries_end(spark, tmp_path):
    def never(batch, number):
        raise Transient("down", 3.0)

    slept = []
    with pytest.raises(Transient):
        notify.retried(never, 3, slept.append)(None, 0)
    assert slept == [3.0, 3.0]


# classifiers


def test_a_classifier_that_runs_out_cools_down():
    now, calls = [0.0], []

    def first(texts):
        calls.append(("first", list(texts)))
        if now[0] < 50 and "big" in texts:
            raise inference.Exhausted("quota", [{"p": 1.0}] * texts.index("big"))
        return [{"p": 1.0}] * len(texts)

    def second(texts):
        calls.append(("second", list(texts)))
        if now[0] > 60:
            raise inference.Exhausted("quota")
        return [{"n": 1.0}] * len(texts)

    ask = inference.Fallback([("first", first), ("second", second)], 100.0, lambda: now[0])
    names = lambda texts: [name for name, _ in ask(texts)]
    assert names(["a", "b"]) == ["first"] * 2
    assert names(["a", "big", "c"]) == ["first", "second", "second"]
    assert names(["d"]) == ["second"] and calls[-1] == ("second", ["d"])  # the first one isn't asked
    now[0] = 70.0
    with pytest.raises(inference.AllExhausted) as e:
        ask(["e"])
    assert e.value.retry_after_s == 30.0
    now[0] = 100.5
    assert names(["f"]) == ["first"]
    assert ask([]) == []
    with pytest.raises(ValueError):
        inference.Fallback([])


def test_fallback_inside_tasks(spark):
    def load():
        def small(texts):
            if any(t == "7" for t in texts):
                raise inference.Exhausted("quota")
            return [{"p": 0.75}] * len(texts)

        return [("small", small), ("rest", lambda texts: [{"n": 1.0}] * len(texts))]

    df = spark.range(10).coalesce(1).select(F.col("id").cast("string").alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r.t: r.s for r in df.select("t", inference.scores_with_fallback(load, ["p", "n"])("t").alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[str(i)].labeler for i in range(10)] == ["small"] * 4 + ["rest"] * 6
    assert got["0"].scores == {"p": 0.75, "n": 0.0} and got["9"].scores == {"p": 0.0, "n": 1.0}
