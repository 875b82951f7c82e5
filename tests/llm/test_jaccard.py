"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=40)
    texts = [None, "", "one two", "One  two", "x"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(6, 300)) + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    big = rng.choices(words, k=120)
    for _ in range(40):  # a large group of near copies
        copy = list(big)
        copy[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent,block,hot", [(100_000, 20_000, 100_000), (0, 7, 100_000), (100_000, 7, 5)])
def test_stage_keeps_the_first_of_jaccard_groups(spark, monkeypatch, frequent, block, hot):
    import corpus_pipeline as p
    from tidewatch.llm import jaccard

    for name, value in (("FREQUENT", frequent), ("BLOCK_ROWS", block), ("HOT_ROWS", hot)):
        monkeypatch.setattr(jaccard, name, value)
    stage = dict(p.STAGES)["simhash_near_dedup"]
    given = spark.createDataFrame(made(), DOCS)
    for df in [given, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")] if block > 7 else [given]:
        sets = {r.doc_id: brute.shingles(r.text) for r in df.collect()}
        want = brute.groups(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
        got = stage(spark, df, "")
        assert got.columns == df.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert stage(spark, given.limit(0), "").count() == 0


def test_one_row_of_each_group_stays(spark):
    from tidewatch.llm import simhash

    long = "one two three four five six seven eight nine ten " * 3
    rows = [(7, long, 1), (7, long, 1), (7, long + "x", 2), (7, "other words stand in this text", 3), (None, long, 4), (None, "no one has this one", 5), (None, "no one has this one", 5), (9, None, 6), (8, " \t ", 7), (None, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__n` int").withColumn("__id", F.lit(1)).withColumn("row", F.lit(2))
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(7, min((long, long + "x"), key=lambda t: hashlib.md5(t.encode()).hexdigest())), (7, "other words stand in this text"), (None, "no one has this one"), (8, " \t ")], key=repr
    )
    named = sorted(((r.doc_id, r.component_id) for r in simhash.similar(df).collect()), key=repr)
    assert named == sorted([(7, 7)] * 4 + [(None, 7), (None, None), (None, None), (9, 8), (8, 8), (None, 8)], key=repr)


def test_spanning_forest_has_true_pairs():
    from tidewatch.llm.jaccard import spanning

    rng = np.random.default_rng(2)
    i = rng.integers(0, 400, 900)
    j = np.minimum(i + rng.integers(0, 3, 900), 399)
    a, b = spanning(400, iter([(i[:500], j[:500]), (i[500:], j[500:])]))
    given = set(zip(i.tolist(), j.tolist()))
    assert set(zip(a.tolist(), b.tolist())) <= given
    linked = lambda pairs: brute.groups(list(range(400)), lambda x, y: (x, y) in pairs or (y, x) in pairs)
    want = linked(given)
    assert linked(set(zip(a.tolist(), b.tolist()))) == want
    assert a.size == 400 - len(set(want.values()))
    hub = np.arange(1, 5000)
    x, y = spanning(5000, iter([(np.zeros(4999, int), hub), (hub[:-1], hub[1:])]))
    assert x.size == 4999
