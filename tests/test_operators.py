"""Merges, latest rows, surge detection and streams on small made-up cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import heat, latest, merge, sampling, windows
from tidewatch.streaming import jobs
from tidewatch.streaming.feed import ChangeFeed

T0 = datetime(2023, 5, 14, 21, 30)
POST = "post_id string, board string, author string, title string, content string, url string, push_count int, boo_count int, comment_count int, created_at timestamp, crawled_at timestamp, is_deleted boolean"


def post(minutes=0, title="t", deleted=False, key="a.M.1.A.001", author="x", n=1):
    return (key, "a", author, title, "c", "u", 1, 0, n, T0, T0 + timedelta(minutes=minutes), deleted)


def merged(spark, old, new):
    got = merge.merge_posts(spark.createDataFrame(old, POST), spark.createDataFrame(new, POST)).collect()
    return got[0] if got else None


@pytest.mark.parametrize(
    ("old", "new", "action", "title", "deleted"),
    [
        ([post()], [post()], "keep", "t", False),  # replay
        ([post(5)], [post(0, "n")], "keep", "t", False),  # older
        ([post()], [post(5, "n")], "update", "n", False),
        ([post()], [post(5)], "keep", "t", False),  # newer without changes
        ([post()], [post(5, None, True)], "delete", "t", True),
        ([post(5)], [post(0, None, True)], "keep", "t", False),  # older delete
        ([post(0, deleted=True)], [post(5)], "update", "t", False),  # brought back
        ([post(0, deleted=True)], [post(5, deleted=True)], "keep", "t", True),
        ([], [post()], "insert", "t", False),
    ],
)
def test_merge_posts(spark, old, new, action, title, deleted):
    got = merged(spark, old, new)
    assert (got.action, got.title, got.is_deleted) == (action, title, deleted)
    assert got.crawled_at == (old or new)[0][10] if action == "keep" else new[0][10]


def test_merge_posts_ignores(spark):
    assert merged(spark, [], [post(deleted=True)]) is None
    assert merged(spark, [post()], [post(5, "n", author="other")]).author == "x"
    again = merged(spark, [post(5, "n")], [post(5, "n")])
    assert again.action == "keep"


def test_newest_snapshot_wins(spark):
    got = merge.newest_snapshots(spark.createDataFrame([post(0), post(5, "n"), post(5, None, True)], POST)).collect()
    assert [(r.title, r.is_deleted) for r in got] == [("n", False)]


def test_sync_comments(spark):
    schema = "post_id string, floor int, type string, author string, content string, commented_at timestamp"
    row = lambda f, kind="push", p="p": (p, f, kind, "u", f"c{f}", T0)
    old = spark.createDataFrame([row(1), row(2), row(3), row(1, p="q")], schema)
    fresh = spark.createDataFrame([row(1), row(2, "boo"), row(1, "boo", "q"), row(5, p="r")], schema)
    targets = spark.createDataFrame([("p", 2), ("r", 5)], "post_id string, max_floor int")
    got = {(r.post_id, r.floor): (r.type, r.action) for r in merge.sync_comments(old, targets, fresh).collect()}
    assert got == {("p", 1): ("push", "keep"), ("p", 2): ("boo", "update"), ("p", 3): ("push", "delete"), ("q", 1): ("push", "keep"), ("r", 5): ("push", "insert")}
    empty = spark.createDataFrame([("p", 0)], "post_id string, max_floor int")
    assert {r.action for r in merge.sync_comments(old.where("post_id = 'p'"), empty, fresh.limit(0)).collect()} == {"delete"}


def test_latest_whatever_the_order(spark):
    made = [("p", 1, i, "true" if i == 9 else "false", "c", f"v{i}") for i in range(10)] + [("p", 2, 3, None, "c", "w")]
    random.Random(1).shuffle(made)
    df = spark.createDataFrame(made, "post_id string, floor int, lsn long, deleted string, op string, content string")
    now = latest.comments_latest(df)
    assert {(r.floor, r.content, r.is_deleted) for r in now.collect()} == {(1, "v9", True), (2, "w", False)}
    assert [r.floor for r in latest.live(now).collect()] == [2]


def test_samples_are_stable(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    one = sampling.stratified(df, ["g"], "id", 5, 7).collect()
    assert sorted(one) == sorted(sampling.stratified(df.repartition(9), ["g"], "id", 5, 7).collect()) and len(one) == 15
    assert sorted(one) != sorted(sampling.stratified(df, ["g"], "id", 5, 8).collect())
    import zlib

    kept = {r.id for r in df.where(sampling.in_percent(F.col("id"), 5)).collect()}
    assert kept == {i for i in range(500) if zlib.crc32(str(i).encode()) % 100 < 5}


def test_windows(spark):
    counts = spark.createDataFrame([("a", 1, 3), ("a", 4, 2), ("a", 20, 1)], "k string, bucket long, n long")
    assert sorted(r.total for r in windows.sliding(counts, ["k"], 4).collect()) == [1, 3, 5]
    assert sorted(r.bucket for r in windows.grid(counts, ["k"], 5).collect()) == [1, 2, 3, 4, 15, 16, 17, 18, 19, 20]
    series = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "k string, bucket long, n long")
    got = {r.bucket: r for r in windows.ewma(series, ["k"], "n", 0.1, 1.0).collect()}
    assert (got[1].mean, got[1].var, got[1].z) == (10, 0, None)
    assert got[2].mean == pytest.approx(11) and got[2].var == pytest.approx(9) and got[2].z == pytest.approx(10)


def test_baseline_is_a_smoothed_mean_and_square():
    b, m, q = heat.Baseline(), None, None
    for values in ([3, 3, 9], [0], [], [7, 1, 1, 1], [12]):
        b.update(values, 0.25)
        if values:
            first, square = sum(values) / len(values), sum(v * v for v in values) / len(values)
            m, q = (first, square) if m is None else (0.75 * m + 0.25 * first, 0.75 * q + 0.25 * square)
        assert (b.mean, b.second) == (pytest.approx(m), pytest.approx(q))
    assert b.samples == 4
    assert b.z(m + 6, 0.1) == pytest.approx(6 / (q - m * m) ** 0.5) and b.z(m + 6, 100.0) == pytest.approx(0.06)


RULES = heat.SurgeRules(window=4, warmup=6, longest_gap=50, least_board=12, least_post=9, least_z=2.5, quiet=7, grace=1)
START = 1_234_567


def fold(steps, board=None):
    """Triggers of (minute after the start, post, comments) in order."""
    board = board or heat.Board()
    return [t for m, p, n in steps for t in board.take("b", p, START + m, START + m, RULES, n)]


CALM = [(m, "calm", 1) for m in range(9)]


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([(9, "loud", 17), (10, "calm", 1)], [("board", 20, ["loud", "calm"]), ("post", 17, ["loud"])]),
        ([(9, "loud", 8), (9, "calm", 7), (10, "calm", 1)], [("board", 18, ["calm", "loud"]), ("post", 10, ["calm"])]),
        ([(9, "loud", 8), (9, "other", 8), (10, "calm", 1)], [("board", 19, ["loud", "other", "calm"])]),
        ([(9, "loud", 17)], []),  # its minute isn't over
        ([(9, "loud", 5), (10, "calm", 1)], []),
    ],
)
def test_windows_that_stand_out(steps, want):
    assert [(t[0], t[3], t[6]) for t in fold(CALM + steps)] == want


def test_no_surge_before_the_warmup():
    assert fold(CALM[:4] + [(4, "loud", 90), (5, "calm", 1)]) == []


@pytest.mark.parametrize(("again", "posts"), [(14, 1), (17, 2)])
def test_a_unit_is_quiet_for_a_while(again, posts):
    found = fold(CALM + [(9, "loud", 40), (10, "calm", 1), (again, "loud", 300), (again + 1, "calm", 1)])
    assert sum(t[0] == "post" for t in found) == posts


def test_minutes_too_far_back_and_long_gaps():
    board = heat.Board()
    fold([(5, "p", 2), (4, "p", 1), (3, "p", 1), (5, "q", 1)], board)
    assert board.minutes == {START + 5: {"p": 2, "q": 1}, START + 4: {"p": 1}}
    fold([(5_000, "p", 1)], board)
    assert board.board.samples == RULES.longest_gap and board.minutes == {START + 5_000: {"p": 1}}
    fold([(5_002, "p", 1)], board)
    assert sorted(board.minutes) == [START + 5_000, START + 5_002] and board.board.samples == RULES.longest_gap + 2


def cdc(spark):
    start = "2023-05-14 21:30:00"
    calm = jobs.surge(start, "a", 3, 1, 30, spark)
    busy = jobs.surge("2023-05-14 22:10:00", "a", 1, 60, 2, spark).withColumn("lsn", F.col("lsn") + 1000)
    other = jobs.surge(start, "b", 2, 2, 20, spark)
    return calm.unionAll(busy).unionAll(other)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = cdc(spark)
    config = heat.SurgeRules(warmup=5, least_board=30, least_post=30)
    want = sorted(map(tuple, heat.alerts(heat.detect(events, config), config).collect()), key=repr)
    assert {(r[1], r[3]) for r in want} == {("board", "a"), ("post", "a")}
    assert heat.detect(events.withColumn("op", F.lit("u")), config).count() == 0
    # time-ordered files, one a micro-batch, with a restart in between
    ordered = sorted(events.collect(), key=lambda r: (r.changed_at, r.lsn))
    cut = [ordered[:40], ordered[40:60], ordered[60:]]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate(cut):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(source))
        frame = spark.readStream.schema(events.schema).parquet(str(source))
        q = jobs.alert_stream(frame, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == want


def plain_triggers(rows, config, cuts=()):
    """Each comment folded by itself in order of change numbers; the state is stored and loaded at the cuts."""
    out = []
    for name in {r.board for r in rows}:
        board = heat.Board()
        for n, r in enumerate(sorted((r for r in rows if r.board == name), key=lambda r: (r.lsn, r.minute, r.post_id))):
            if n in cuts:
                counts = [(m, p, k) for m, posts in board.minutes.items() for p, k in posts.items()]
                board = heat.Board.restored(board.figures(), counts, dict(board.alerted))
            out += [(name, *t) for t in board.take(name, r.post_id, r.minute, r.minute, config)]
    return sorted(out, key=repr)


def test_surges_of_a_batch_fold_counts(spark, capsys):
    events = cdc(spark)
    events = events.unionAll(events.withColumn("board", F.lit(None).cast("string")))
    config = heat.SurgeRules(warmup=5, least_board=30, least_post=30)
    want = plain_triggers(heat.countable(events, config).collect(), config)
    found = heat.detect(events, config)
    assert want and sorted(map(tuple, found.collect()), key=repr) == want
    found.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out  # no board is held as a whole


def test_comments_count_in_order_of_arrival(spark, monkeypatch):
    """Late comments are left out or counted by what had arrived before them, whatever the cuts of batches."""
    rng = random.Random(9)
    monkeypatch.setattr(heat, "STRETCH", 40)
    config = heat.SurgeRules(warmup=5, least_board=12, least_post=8, quiet=6, least_z=1.0, window=4, longest_gap=50)
    made, minute = [], 100
    for lsn in range(900):
        minute += rng.random() < 0.25
        if 300 < lsn < 420 or 700 < lsn < 780:
            minute -= rng.random() < 0.2
        late = rng.choice((0, 0, 0, 0, 1, 2, 3, 9, 18))
        made.append((rng.choice(("a", "b")), f"p{rng.randrange(3)}", minute - late, lsn, "c", "false"))
    df = spark.createDataFrame(made, "board string, post_id string, m long, lsn long, op string, deleted string")
    df = df.withColumn("changed_at", F.timestamp_seconds(F.col("m") * 60)).withColumn("commented_at", F.col("changed_at"))
    rows = heat.countable(df, config).collect()
    want = plain_triggers(rows, config)
    assert len(want) > 4 and want == plain_triggers(rows, config, cuts=(7, 100, 101, 250, 333))
    assert sorted(map(tuple, heat.detect(df, config).collect()), key=repr) == want
    by_minute = plain_triggers([r.__class__(**{**r.asDict(), "lsn": r.minute * 1000 + r.lsn}) for r in rows], config)
    assert by_minute != want  # the order does matter here
    # eighteen minutes behind the newest is too late, two are not
    one = heat.arrivals(df.where("lsn < 0").unionAll(spark.createDataFrame(
        [("a", "p", 118, 1, "c", "false"), ("a", "p", 100, 2, "c", "false"), ("a", "p", 116, 3, "c", "false")], df.drop("changed_at", "commented_at").schema
    ).withColumn("changed_at", F.timestamp_seconds(F.col("m") * 60)).withColumn("commented_at", F.col("changed_at"))), config)
    assert sorted((r.stage, r.minute, r.n) for r in one.collect()) == [(118, 116, 1), (118, 118, 1)]
    assert heat.detect(df, config, now=10_000).count() == 0  # all closed minutes are long past


def test_merge_stream_is_idempotent(spark, tmp_path):
    table = jobs.BucketTable(str(tmp_path / "t"), ["k"], spark.createDataFrame([], "k string, lsn long, v string"), buckets=16)
    run_batch = jobs.merge_latest(table, ["lsn"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, lsn long, v string")
    assert table.read(spark).count() == 0
    run_batch(rows(*[(c, 1, "x") for c in "abcdefgh"]), 0)
    for _ in range(2):  # a batch that is run again
        run_batch(rows(("a", 2, "z"), ("b", 0, "old")), 1)
    run_batch(rows(), 2)
    got = {tuple(r) for r in table.read(spark).collect()}
    assert got == {("a", 2, "z")} | {(c, 1, "x") for c in "bcdefgh"}
    folders = {k: sorted(v) for k, v in table._folders(spark).items()}
    assert len(folders) > 2 and sum(len(v) == 2 for v in folders.values()) <= 2  # others weren't written again
    assert table.vacuum(spark, keep=1) == sum(len(v) == 2 for v in folders.values()) and {tuple(r) for r in table.read(spark).collect()} == got


def test_snapshot_stream(spark, tmp_path):
    table = jobs.BucketTable(f"{tmp_path}/posts", ["post_id"], spark.createDataFrame([], POST))
    feed = ChangeFeed(f"{tmp_path}/changes", ["post_id"])
    step = jobs.merge_snapshots(table, feed)
    step(spark.createDataFrame([post(0)], POST), 0)
    for _ in range(2):
        step(spark.createDataFrame([post(5, "n")], POST), 1)
    step(spark.createDataFrame([post(5, "n")], POST), 2)
    told = sorted((r.change, r.batch, r.op, r.before and r.before.title, r.after.title) for r in feed.read(spark).collect())
    assert told == [(0, 0, "c", None, post(0)[3]), (1, 1, "u", post(0)[3], "n")] and table.read(spark).count() == 1
    assert feed.ranges(spark) == {0: (0, 1), 1: (1, 1), 2: (2, 0)}


def test_long_payloads_are_one_line(spark, tmp_path):
    import base64
    import json

    from tidewatch.sources import files

    long = "x" * 200
    messages = spark.createDataFrame([("t", 0, 1, T0, long.encode(), long.encode())], "topic string, partition int, offset long, timestamp timestamp, key binary, value binary")
    files.write_recording(messages, str(tmp_path / "r"))
    line = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    bad = jobs.parse_json(spark.createDataFrame([(long,)], "value string"), "a int")[1].first().payload_b64
    told = spark.createDataFrame([(long,)], "a string")
    dead = jobs.split_dead_letters(told, F.lit("a"))[1].first().payload_b64
    assert [base64.b64decode(x, validate=True) for x in (line["key_b64"], line["value_b64"], bad)] == [long.encode()] * 3
    assert json.loads(base64.b64decode(dead, validate=True)) == {"a": long}


def test_dead_letters(spark):
    raw = spark.createDataFrame([('{"post_id": "a", "floor": 1, "more": 2}',), ("not json",), ('{"floor": 3}',)], "value string")
    good, bad = jobs.parse_json(raw, "post_id string, floor int")
    assert {tuple(r) for r in good.collect()} == {("a", 1), (None, 3)}
    assert [(r.rule, bytes(__import__("base64").b64decode(r.payload_b64))) for r in bad.collect()] == [("json", b"not json")]
    rows = spark.createDataFrame([("a.M.1.A.0F0", 1, "push", T0, "c"), ("a.M.1.A.0F0", 0, "push", T0, "c"), ("x", 1, "push", T0, "c")], "post_id string, floor int, type string, commented_at timestamp, op string")
    fine, dead = jobs.split_dead_letters(rows, jobs.broken_rule())
    assert fine.count() == 1 and sorted(r.rule for r in dead.collect()) == ["floor", "post_id"]


def test_watchdogs(spark):
    from tidewatch.operators import watch

    seen = [("c", float(t), f == "r", f == "f") for t, f in enumerate("rffffffffxrrf")]
    got = [(r.at, r.restart, r.change, r.restarts) for r in watch.restarts(spark.createDataFrame(seen, "name string, at double, running boolean, failed boolean"), 1, 4).orderBy("at").collect()]
    assert got == [(1.0, True, "failed", 1), (2.0, True, None, 2), (4.0, True, None, 3), (8.0, True, None, 4), (10.0, False, "recovered", 4), (12.0, True, "failed", 1)]
    found = [("m", float(t), f == "1") for t, f in enumerate("1000011001")]
    alerts = watch.missing_alerts(spark.createDataFrame(found, "name string, at double, found boolean"), 2).orderBy("at").collect()
    assert [(r.at, r.change) for r in alerts] == [(1.0, "missing"), (4.0, "alert"), (5.0, "recovered"), (7.0, "missing")]
    slots = [("s", 0.0, True, 5), ("s", 1.0, False, 50), ("s", 2.0, False, 5), ("s", 4.0, False, 5), ("s", 5.0, None, None), ("s", 6.0, True, 5)]
    changes = watch.slot_alerts(spark.createDataFrame(slots, "slot string, at double, active boolean, lag int"), 2, 10).collect()
    assert sorted((r.at, r.alert, r.raised) for r in changes) == [(1.0, "lagging", True), (2.0, "lagging", False), (4.0, "inactive", True), (5.0, "inactive", False), (5.0, "missing", True), (6.0, "missing", False)]


def test_files(spark, tmp_path):
    from tidewatch.sources import files

    examples = spark.createDataFrame([("p", "line\n=1", None), ("q", "", "positive")], files.EXAMPLE)
    files.write_examples(examples, str(tmp_path / "e"))
    assert sorted(map(tuple, files.read_examples(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, examples.collect()))
    messages = spark.createDataFrame([("t", 0, 1, T0, None, bytearray(b"\x00\xff")), ("t", 0, 2, T0, bytearray(b"k"), None)], "topic string, partition int, offset long, timestamp timestamp, key binary, value binary")
    files.write_recording(messages, str(tmp_path / "r"))
    good, bad = files.read_recording(spark, str(tmp_path / "r"))
    assert sorted(map(repr, good.collect())) == sorted(map(repr, messages.collect())) and bad.count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('nothing\n{"topic": "t"}\n{"topic": "t", "partition": 0, "offset": 1, "timestamp_ms": 5, "value_b64": "%%"}\n')
    assert sorted(r.fault for r in files.read_recording(spark, str(tmp_path / "b"))[1].collect()) == ["field", "json", "value"]
    files.write_review(examples, str(tmp_path / "c"))
    assert "'=1" not in (tmp_path / "e").name
    text = files.markdown("Title", spark.createDataFrame([("a|b", 0.5)], "x string, y double"), ["x", "y"])
    assert text.splitlines()[-1] == r"| a\|b | 0.500 |"


def test_text_model(spark):
    from tidewatch.operators import textmodel

    made = [(i, "the same words " * 40 + ("good fine nice" if i % 3 else "bad sad mad"), "positive" if i % 3 else "negative") for i in range(60)]
    odd = [(100, None, None), (101, "", None), (102, "good nice", None), (103, "sad mad", None), (None, "zzz", None)]
    df = spark.createDataFrame(made + odd, "id long, text string, polarity string").withColumns({c: F.lit(7) for c in ("row", "term", "features", "a.b")})
    got = {r.id: r for r in textmodel.held_out(df, "id").collect()}
    assert len(got) == 65 and all(got[i].predicted == p for i, _, p in made) and (got[102].predicted, got[103].predicted) == ("positive", "negative")
    assert all(abs(sum(r.scores.values()) - 1) < 1e-6 and set(r.scores) == {"positive", "negative"} and r["a.b"] == 7 for r in got.values())
    assert textmodel.VOCABULARY == 200_000
    none = df.where("false")
    assert textmodel.held_out(none, "id").count() == 0 and textmodel.fit_predict(none, df).where("predicted IS NULL AND scores IS NULL").count() == 65
    only = df.where("polarity = 'positive' AND id < 9")
    assert {(r.predicted, r.scores["positive"]) for r in textmodel.fit_predict(only, df).collect()} == {("positive", 1.0)}


def test_grams_of_odd_texts(spark, monkeypatch):
    import re
    from collections import Counter

    from tidewatch.functions import grams
    from tidewatch.operators import textmodel

    draw = random.Random(5)
    texts = ["", " \n ", "a", "a\0 \0", " a\tb\x0bc ", "\U0010ffff\U0001f600x y\u3000z", "ab cd " * 300]
    texts += ["".join(draw.choice("ab \n\t\0\u00e9\u6f22\U0001f600") for _ in range(draw.randrange(60))) for _ in range(200)]
    told = [Counter(g for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w for n in (1, 2, 3) for g in ((" " + w + " ")[i : i + n] for i in range(len(w) + 3 - n))) for t in texts]
    for piece in (grams.PIECE, 1, 2, 5, 64):
        monkeypatch.setattr(grams, "PIECE", piece)
        for t, want in zip(texts, told):
            numbers, n = grams.counted(t)
            terms = grams.terms(numbers).to_pylist()
            assert dict(zip(terms, n.tolist())) == want and terms == sorted(terms) and [grams.number(x) for x in terms] == numbers.tolist()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "row long, t string")
    counts = textmodel.term_counts(rows, "t").cache()
    assert {(r.row, r.term): r.n for r in counts.collect()} == {(i, g): n for i, c in enumerate(told) for g, n in c.items()}
    known = textmodel.vocabulary(counts, len(texts) + 1, 100).cache()
    want = {r.row: r.features for r in textmodel.vectors(rows, textmodel.weights(counts, known), 100).collect()}
    got = {r.row: r.features for r in rows.select("row", textmodel.encoder(known)(F.col("t")).alias("features")).collect()}
    assert len(got) == len(want) == len(texts) + 1 and known.count() == 100
    for i, v in want.items():
        assert got[i].size == 100 and got[i].indices.tolist() == v.indices.tolist() and got[i].values == pytest.approx(v.values, abs=1e-14)


def test_text_model_scores_texts_where_they_lie(spark):
    from tidewatch.operators import textmodel

    df = spark.createDataFrame([(i, "good fine" if i % 3 else "bad sad", "p" if i % 3 else "n") for i in range(40)], "id long, `a.text` string, label string")
    out = textmodel.held_out(df, "id", "a.text", "label")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # no shuffle, join or written vector between a text and its scores, and each text is encoded once
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 2
    assert all(r.predicted == r.label for r in out.collect())


def test_text_model_against_a_dense_solve(spark):
    """Weights and coefficients, by counting in plain Python and by descending the whole gradient."""
    import math
    from collections import Counter

    import numpy as np
    from tidewatch.operators import textmodel

    texts = [("ab ab c", "p"), ("ab d", "p"), ("c c c d", "n"), ("d e ab", "n"), ("e", "q"), ("e ab e", "q"), ("c", "p")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row long, t string, label string")
    counts = textmodel.term_counts(rows, "t").cache()

    def grams(text):
        return Counter(g for w in text.split() for n in (1, 2, 3) for g in ((" " + w + " ")[i : i + n] for i in range(len(w) + 3 - n)))

    told = [grams(t) for t, _ in texts]
    assert {(r.row, r.term): r.n for r in counts.collect()} == {(i, g): n for i, c in enumerate(told) for g, n in c.items()}
    df = Counter(g for c in told for g in c)
    terms = sorted((g for g in df if df[g] > 1), key=lambda g: (-sum(c[g] for c in told), g))
    x = np.array([[(1 + math.log(c[g])) * math.log((len(texts) + 1) / (df[g] + 1)) if c[g] else 0.0 for g in terms] for c in told])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    known = textmodel.vocabulary(counts, len(texts)).cache()
    assert [r.term for r in known.orderBy("at").collect()] == terms
    made = textmodel.vectors(rows, textmodel.weights(counts, known), len(terms))
    assert np.allclose([r.features.toArray() for r in made.orderBy("row").collect()], x)

    classes = ["n", "p", "q"]
    model = textmodel.fit(made.join(rows, "row").select("features", "label"), classes, "label", regularisation=0.1, rounds=200)
    y = np.array([[c == t[1] for c in classes] for t in texts], float)
    share = (len(texts) / (len(classes) * y.sum(axis=0)))[y.argmax(axis=1)]
    w, b = np.zeros((len(classes), len(terms))), np.zeros(len(classes))
    for _ in range(20_000):
        p = np.exp(x @ w.T + b)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) * share[:, None] / share.sum()
        w, b = w - 2.0 * (g.T @ x + 0.1 * w), b - 2.0 * g.sum(axis=0)
    assert np.abs(model.coefficientMatrix.toArray() - w).max() < 1e-3
    centred = model.interceptVector.toArray()
    assert np.abs(centred - centred.mean() - (b - b.mean())).max() < 1e-3
