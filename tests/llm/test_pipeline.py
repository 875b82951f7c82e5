from __future__ import annotations

from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as p
    from tidewatch.llm import mixing, toxicity
    from tidewatch.llm.common import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    stage = dict(p.STAGES)

    calm = written(stage["toxicity"](spark, docs, SMALL), "t")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.classify(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = written(stage["simhash_near_dedup"](spark, calm, SMALL), "s")
    sets = {r.doc_id: brute.shingles(r.text) for r in calm.collect()}
    groups = brute.groups(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in single.collect()} == set(groups.values())

    cut = written(stage["suffix_array_dedup"](spark, single, SMALL), "c")
    want = {r[0]: r[1] - r[2] for r in brute.repeats([(r.doc_id, r.text) for r in single.collect()])}
    for r in cut.collect():
        # bytes of a character that is cut in part go with it
        assert want[r.doc_id] - 8 <= len(r.text.encode()) <= want[r.doc_id] and r.n_chars == len(r.text)

    mixed = written(stage["mixing"](spark, cut, SMALL), "m")
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(cut).collect())
    packed = stage["best_fit_packing"](spark, mixed, SMALL)
    assert packed.where("piece = 0").count() == mixed.count()
    for df in (calm, single, cut, mixed):
        assert df.columns == columns
    assert p.run(spark, SMALL).count() == packed.count()


ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "the word is out and about here now", "en", "a", 15), (3, " \n\t ", "en", None, 4),
    (4, "the same line of words " * 9, "en", "a", 1), (4, "the same line of words " * 9, "en", "a", 1), (5, "the same line of words " * 9, "fr", "b", 1),
    (6, "été " * 40_000, "fr", "b", 1), (7, "12 34 --", "de", "c", 8), (8, None, "en", "a", 0),
]
CLASHING = {"copy": 99, "shuffle_key": "mine", "__toxicity": 0.25, "a.b": 1, "score": "s", "c0": True, "node": None, "component": 7}


def odd_tables(spark, folder, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in CLASHING.items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 0, 0), (4, 1, None), (None, 0, 1), (7, 0, 1), (7, 0, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as p
    from tidewatch.llm.common import written

    odd_tables(spark, tmp_path / "odd", ODD)
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    given, ids = docs.columns, []
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path / "odd")), name)
        assert docs.columns == given
        kept = docs.collect()
        assert all(r[c] == v for r in kept for c, v in CLASHING.items())
        ids.append(sorted(map(str, (r.doc_id for r in kept))))
    # equal texts and those without words are one each
    assert ids[1] == sorted(["1", "4", "6", "7", "None"]) and ids[2] == ids[1]
    assert p.STAGES[-1][1](spark, docs, "").where("piece = 0").count() == docs.count()


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    odd_tables(spark, tmp_path / "odd", ODD)
    odd_tables(spark, tmp_path / "none", [])
    assert p.run(spark, str(tmp_path / "odd")).count() > 0
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_workers_keep_no_chunks_after_packing(spark):
    import pyarrow as pa

    from tidewatch.llm import packing
    from tidewatch.llm.queries import vocabulary

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', md5(string(id)), ' and x', id, '!') AS text").coalesce(1)

    def held(it):
        for _ in it:
            pass
        n = sum(len(c.known) for c in packing._CACHES.values())
        yield pa.RecordBatch.from_arrays([pa.array([len(packing._CACHES)]), pa.array([n])], ["caches", "chunks"])

    rows = packing.pieces(docs, vocabulary()).coalesce(1).collect()
    assert len(rows) == 3000 and all(r.length > 2 for r in rows)
    # every task's worker, those that tokenized among them
    seen = spark.range(0, 8, 1, 8).mapInArrow(held, "caches long, chunks long").collect()
    assert sum(r.caches for r in seen) > 0 and sum(r.chunks for r in seen) == 0


def test_chunks_are_learned_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    from tidewatch.llm import packing
    from tidewatch.llm.queries import vocabulary

    texts = [" ".join(f"wort{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}{'.' * (k % 2)} {i}-{k}" for k in range(300)) for i in range(20)]
    cache = packing.WordCache(vocabulary(), most=2_000)
    want = [cache._encode([t])[0] for t in texts]
    sizes, encode = [], cache._encode

    def counted(chunks):
        sizes.append(len(chunks))
        return encode(chunks)

    monkeypatch.setattr(cache, "_encode", counted)
    monkeypatch.setattr(packing, "LEARN_CHUNKS", 64, raising=False)
    assert cache.ids(pa.array(texts)) == want and cache.ids(pa.array(texts[::-1])) == want[::-1]
    assert max(sizes) <= 64
