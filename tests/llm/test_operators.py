from __future__ import annotations

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids and texts, empty and blank texts, repeated rows and ids, a long text, odd characters.
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "the word is out", "en", "a", 15), (3, " \n\t ", "en", None, 4),
    (4, "the same line of words " * 9, "en", "a", 1), (4, "the same line of words " * 9, "en", "a", 1), (5, "the same line of words " * 9, "fr", "b", 1),
    (6, "été " * 30_000, "fr", "b", 1), (7, "12 34 --", "de", "c", 8), (8, "under the MIT license", "en", "c", 21), (9, "x", "en", "c", 1), (10, None, "en", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, DOCS)
    # columns whose names the operators use themselves
    return extra.withColumns({c: F.lit(1) for c in ("copy", "media", "score", "fp", "label", "h", "b", "node", "shuffle_key")})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1


def plain_png(raw, n_bytes):
    """The stored form, chunk by chunk and row by row."""

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    lines = b"".join(b"\0" + raw[i : i + 576] for i in range(0, len(raw), 576))
    head = (576).to_bytes(4, "big") + (len(raw) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    parts = [(b"IHDR", head), (b"unPd", n_bytes.to_bytes(8, "big")), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunk(*p) for p in parts)


def plain_feature(raw):
    n, lines = len(raw), [raw[i : i + 576] for i in range(0, len(raw), 576)]
    mean = sum(raw) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in raw) / n)
    steps = [abs(a - b) for line in lines for a, b in zip(line, line[1:])]
    bands = [1000 * sum(64 * k <= x < 64 * (k + 1) for x in raw) // n for k in range(4)]
    shown = ",".join(map(str, bands))
    return f"576x{len(lines)};mean={mean:.3f};std={std:.3f};step={sum(steps) / len(steps):.3f};bands={shown}"


def test_media_round_trip(spark, docs, odd):
    from tidewatch.llm import media

    for df in (docs, odd):
        got = defaultdict(list)
        for r in media.media_columns(df).collect():
            got[r.doc_id].append(r)
        texts = df.select("doc_id", "text").collect()
        assert sum(map(len, got.values())) == len(texts)
        for t in texts:
            raw = media.payload(t.text)
            assert len(raw) % 576 == 0 and raw.rstrip(b"\xff") == (t.text or "").encode()
            same = [r for r in got[t.doc_id] if r.payload_sha256 == hashlib.sha256(raw).hexdigest()]
            assert same and same[0].n_bytes == len((t.text or "").encode()) and same[0].tail_crc32 == zlib.crc32(raw[-32:])
            png = plain_png(raw, same[0].n_bytes)
            assert (same[0].media_bytes, same[0].media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
            assert same[0].feature == plain_feature(raw)
    assert media.media_columns(odd.limit(0)).count() == 0


def test_archive_ranges_and_damage(spark, docs, tmp_path):
    from tidewatch.llm import media

    path = str(tmp_path / "media")
    media.store(docs, path)
    small = media.load(spark, path, range_bytes=4096, batch_bytes=1000)
    assert small.rdd.getNumPartitions() > 5
    assert rows(small.select("doc_id", F.sha2("media", 256))) == rows(media.load(spark, path).select("doc_id", F.sha2("media", 256)))
    archive = next(p for p in (tmp_path / "media").iterdir() if p.suffix == ".zip")
    raw = bytearray(archive.read_bytes())
    raw[200] ^= 255
    archive.write_bytes(raw)
    with pytest.raises(Exception, match="checksum differs"):
        media.load(spark, path, retries=1).count()


def test_archive_retries_a_member_at_its_offset(tmp_path):
    from pyarrow import fs
    from tidewatch.llm.archive import ArchiveReader

    import zipfile

    where = tmp_path / "a.zip"
    with zipfile.ZipFile(where, "w") as z:
        z.writestr("x", b"first")
        z.writestr("y", b"second")
    info = zipfile.ZipFile(where).getinfo("y")
    reader = ArchiveReader({"path": f"file://{tmp_path}"})

    class Broken:
        def read_at(self, n, at):
            raise OSError("gone")

    handle = [Broken()]
    got = reader._member(fs.LocalFileSystem(), str(where), handle, info.header_offset, info.compress_size, info.CRC, "y")
    assert got == b"second" and not isinstance(handle[0], Broken)


# 2


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    made = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:5]]))]
    nan, inf = float("nan"), float("inf")
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [nan] * 8, 1), (203, [inf] + [1.0] * 7, 1), (204, made[0][1], None), (205, [], 1), (206, [1e300] * 8, 1), (207, [1e-300] * 8, 1), (None, made[0][1], 0), (3, made[3][1], 0), (3, made[3][1], 0)]
    # different vectors that share an id, near to different others
    odd += [(300, made[6][1], 0), (300, made[9][1], 0), (300, made[10][1], 1), (301, (np.array(made[6][1]) + 0.001).tolist(), 0), (302, (np.array(made[9][1]) + 0.001).tolist(), 0)]
    return spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block,recall", [(1024, 0.98), (16, 0.98), (16, 2.0)])
def test_embeddings(spark, monkeypatch, block, recall):
    """With a recall that can't be met the exact way is taken."""
    from tidewatch.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "AUDIT_EVERY", 3)
    df = vectors(spark)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df.withColumn("unit", F.lit(0)), min_recall=recall).collect())
    given = [tuple(r) for r in df.collect()]
    fine = [r for r in given if r[0] is not None and r[2] is not None and r[1] and all(np.isfinite(r[1])) and any(r[1])]

    def linked(a, b):
        x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
        return a[2] == b[2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    keyed = {(r[0], n): r for n, r in enumerate(fine)}
    component = brute.groups(list(keyed), lambda a, b: linked(keyed[a], keyed[b]))
    want = Counter()
    for k, r in keyed.items():
        links = sum(linked(r, o) for q, o in keyed.items() if q != k)
        want[(r[0], links, component[k][0], r[0] == component[k][0])] += 1
    for r in given:
        if r not in fine:
            want[(r[0], 0, r[0], True)] += 1
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_count_what_any_shard_finds(spark, monkeypatch, tmp_path):
    """Searches that miss about half of their pairs, each others: all that some shard found is counted, once."""
    from tidewatch.llm import embeddings

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    made = [v for c in base for v in c + rng.normal(size=(8, 8)) * 0.05]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(made)], "vec_id long, embedding array<double>, label string")
    search, folder = embeddings.range_search, str(tmp_path)

    def lossy(queries, u, near, starts, threshold, beam):
        q, v = search(queries, u, near, starts, threshold, beam)
        # the same for both directions of a pair, and different in each graph
        keep = (np.abs(queries[q].sum(axis=1) + u[v].sum(axis=1)) * 1e6 + abs(u.sum()) * 1e3).astype(np.int64) % 2 == 0
        q, v = q[keep], v[keep]
        np.save(f"{folder}/{os.getpid()}-{time.time_ns()}.npy", np.stack([queries[q], u[v]]))
        return q, v

    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 64)
    monkeypatch.setattr(embeddings, "range_search", lossy)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, min_recall=0.0).collect()}
    pairs = {frozenset((x.tobytes(), y.tobytes())) for f in tmp_path.iterdir() for x, y in zip(*np.load(f)) if x.tobytes() != y.tobytes()}
    ends = Counter(x for pair in pairs for x in pair)
    assert sorted(n for n in got.values() if n) == sorted(ends.values())
    units = np.array(made) / np.linalg.norm(made, axis=1, keepdims=True)
    assert 0 < len(pairs) < ((units @ units.T >= 0.98).sum() - len(units)) / 2


def test_embeddings_without_audited_links(spark, caplog):
    """Recall comes from other vectors if none that is asked for has a link."""
    from tidewatch.llm import embeddings

    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.001], "x"), (100, [0.0, 1.0], "x")], "vec_id long, embedding array<double>, label string")
    with caplog.at_level("INFO", logger=embeddings.__name__):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 100: (0, 100)}
    assert "recall 1.0" in caplog.text


# 3


def test_mixing(spark, docs, odd):
    from tidewatch.llm import mixing

    out = mixing.mix(docs, total=4000.0)
    rates = {r.source: r.rate * r.n for r in mixing.source_rates(docs, total=4000.0).collect()}
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert sum(rates.values()) == pytest.approx(4000)
    for s, want in rates.items():
        assert abs(got.get(s, 0) - want) < 6 * want**0.5 + 6
    assert rows(out) == rows(mixing.mix(docs.repartition(7), total=4000.0))
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, weights).select("source").distinct().collect()} == {"src0", "src1"}
    assert set(mixing.mix(odd).columns) == set(odd.columns)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_keeps_columns_and_parts_null_ids(spark):
    from tidewatch.llm import mixing

    made = [(None, f"text {i % 50}", "s", i) for i in range(200)] + [(i, None, None, i) for i in range(100)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, __n int")
    df = df.withColumns({c: F.lit(c) for c in ("__source", "__cdf", "n", "key", "row", "own", "salt", "least", "cdf", "from")})
    out = mixing.mix(df, total=3000.0)
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    got = out.collect()
    assert {r["__n"] for r in got} <= set(range(200)) and all(r["cdf"] == "cdf" and r["from"] == "from" for r in got)
    assert len({r.shuffle_key for r in got if r.doc_id is None}) > 100
    assert abs(len(got) - 3000) < 1200


def test_mixing_without_broadcast(docs, monkeypatch):
    from tidewatch.llm import mixing

    want = rows(mixing.mix(docs))
    monkeypatch.setattr(mixing, "SOURCES_BROADCAST", 0)
    assert rows(mixing.mix(docs)) == want


@pytest.mark.parametrize("rate", [0.0, 1.5, 100.0, 700.0, 800.0, 5000.0])
def test_mixing_at_large_rates(spark, rate):
    from tidewatch.llm import mixing

    got = spark.range(1).select(mixing.poisson_least(F.lit(rate)).alias("a"), mixing.poisson_cdf(F.lit(rate)).alias("c")).first()
    term = lambda k: math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
    want = np.cumsum([term(k) for k in range(got.a + len(got.c))])
    assert (got.a == 0 or want[got.a - 1] < 1e-20) and got.c[-1] == 1
    assert np.allclose(got.c, want[got.a :], rtol=0, atol=1e-9)
    one = spark.createDataFrame([(4, "x", "en", None, 1)], DOCS)
    u = int(hashlib.md5(b"7:4").hexdigest()[:13], 16) / (1 << 52)
    assert mixing.mix(one, total=rate).count() == int((want <= u).sum())


# 4


def test_packing(docs, odd):
    from tidewatch.llm import packing
    from tidewatch.llm.queries import vocabulary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    for df, tasks in ((docs, packing.TASK_TOKENS), (odd, 5000)):
        got = packing.pack(df, vocabulary(), task_tokens=tasks).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 4096):
                part = np.array(ids[k : k + 4096], "<u4")
                want[(r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for spans in bins.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 4096
        if df is docs:
            assert len(bins) <= 1.03 * sum(r.length for r in got) / 4096 + 1
    assert packing.pack(odd.limit(0), vocabulary()).count() == 0


def test_packing_deals_equal_rows_to_all_tasks(spark):
    from tidewatch.llm import packing
    from tidewatch.llm.queries import vocabulary

    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(df, vocabulary(), task_tokens=5_000).collect()
    tasks = Counter(r.sequence_id >> 40 for r in got)
    assert len(got) == 40_000 and len(tasks) == 8 and max(tasks.values()) < 7_500


def test_packing_of_special_tokens(spark):
    from tidewatch.llm import packing
    from tidewatch.llm.queries import vocabulary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|> the word", "A <|ENDOFTEXT|> b", "x  <|endoftext|><|endoftext|>\n y", "the < | endoftext |> word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(df, vocabulary()).collect()}
    ids = [np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for x in texts]
    assert ids[0].tolist() == [320, 49407, 321, 1]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


def test_packing_looks_up_each_chunk_once_a_batch():
    import pyarrow as pa
    from tidewatch.llm.packing import TOGETHER_BYTES, WordCache, _together
    from tidewatch.llm.queries import vocabulary

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    rng = random.Random(6)
    odd = [None, "", " ", "  \n", " a\x0b b\x1c c\x85 ", "\ufeffA É é.", "x, y. .. ,", "<|EndOfText|> a b", "don't 'S  x", "\x00 a\x00b", "İ ß"]
    texts = odd + [" ".join(rng.choice(["word", "Word,", "été.", "x2", " "]) + rng.choice(["", "s", "\t"]) for _ in range(50)) for _ in range(400)]
    cache = WordCache(vocabulary())
    want = [np.array(cache.full.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    cache.known = Counted(cache.known)
    assert cache.ids(pa.array(texts, pa.string())) == want
    assert cache.known.asked < 200 and cache.ids(pa.array([], pa.string())) == []
    # a cache that is emptied again and again
    small = WordCache(vocabulary(), most=5)
    assert [x for at in range(0, len(texts), 7) for x in small.ids(pa.array(texts[at : at + 7], pa.string()))] == want
    # batches of 500 rows are looked at together, in order
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array(["x" * 1000] * 500)], ["i", "t"]) for k in range(0, 6000, 500)]
    got = list(_together(batches))
    assert [i for ids, _ in got for i in ids.to_pylist()] == list(range(6000)) and len(got) == 3 and got[0][1].nbytes >= TOGETHER_BYTES - 500 * 8


def test_best_fit_closes_the_fullest():
    from tidewatch.llm.packing import best_fit

    assert list(best_fit([60, 50, 40, 50], 100, 2)) == [(0, 0), (1, 0), (0, 60), (1, 50)]
    assert list(best_fit([60, 50, 70, 30], 100, 2)) == [(0, 0), (1, 0), (2, 0), (2, 70)]


# 5


def test_licenses_on_odd_rows(odd):
    from tidewatch.llm.licenses import scan

    got = scan(odd).collect()
    assert len(got) == len(ODD)
    mit = next(r for r in got if r.doc_id == 8)
    assert (mit.n_words, mit.n_base, mit.first_word, mit.last_word, mit.base_labels, mit.labels, mit.score) == (4, 1, 0, 0, "mit", "mit", 1.0)
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in got if r.doc_id != 8)
    assert scan(odd.limit(0)).count() == 0


#: Sentences that share many words with a template and are no notices of its license.
NOT_NOTICES = [
    "Released under the GPL license.",
    "This package is released under the BSD license",
    "the license under which it was released",
    "code by nc licensed under cc 4",
    "it was released in spring " + "and then " * 6 + "under the new terms a license is due",
    "Veröffentlicht mit Dank: the work was released under a license",
    "This work is licensed under the GNU Lesser thing, General notes, Public domain, version 3.",
]


def test_licenses_of_other_names(spark):
    from tidewatch.llm import licenses

    df = spark.createDataFrame(list(enumerate(NOT_NOTICES)), "doc_id long, text string")
    assert [(r.doc_id, r.labels, r.score) for r in licenses.scan(df).collect() if r.labels or r.score] == []


def test_license_templates(spark):
    from tidewatch.llm.licenses import scan

    texts = ["a\nThis work is licensed under GNU General Public License, version 3.\nb", "cc by nc cc by nc apache license version 2", "license version under the"]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "gpl-3" and 0.8 <= got[0].score < 1 and got[0].n_base == 0
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "apache-2,cc-by-nc")
    assert got[2].labels == ""


def test_license_templates_in_wrapped_lines(spark):
    from tidewatch.llm.licenses import scan

    notice = (
        "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated\ndocumentation files"
    )
    gpl = "it under the terms of the GNU General\n Public License as published by the Free\n Software Foundation, either\n version 3"
    filler = "some other words of prose stand here and go on\n" * 40
    half = notice[: notice.index("obtaining")]
    texts = [filler + notice + "\n" + filler, notice.replace("\n", "\n# "), filler + gpl, filler + half + filler, notice.replace("\n", "\n" + filler)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["mit", "mit", "gpl-3", "", ""]  # a GPL's notice isn't the lesser one's
    assert got[0].score == 1.0 and got[0].n_base == 0


# 6


def test_language(docs, odd):
    from tidewatch.llm import language

    model = language.train(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    told = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= told
    assert language.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert [language.has_letter(t) for t in ("½ ² ³ ٣ _", "5 ª", "é", "-文", "", None)] == [False, True, True, True, False, False]


def test_language_against_plain_kernel_regression(spark):
    """With every training row a landmark, the model is ridge regression on the plain kernel of n-gram sets."""
    from tidewatch.llm import language

    rng = random.Random(6)
    made = []
    for i in range(90):
        lang = ("aa", "bb", "cc")[i % 3]
        letters = {"aa": "abcde", "bb": "cdefg", "cc": "éghix"}[lang]
        made.append((i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.choice((3, 20, 2500)))), lang))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(df, rows=1000, landmarks=600, ridge=0.5)

    def grams(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    sets = [grams(t) for _, t, _ in made]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    known = [i for i, _, _ in made if zlib.crc32(str(i).encode()) % 3 != 1]
    values, vectors = np.linalg.eigh(kernel[np.ix_(known, known)])
    keep = values > 1e-6 * values[-1]
    x = kernel[:, known] @ vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([x, np.ones((len(made), 1))])
    count = Counter(made[i][2] for i in known)
    w = np.array([len(known) / 3 / count[made[i][2]] for i in known])[:, None]
    y = np.array([[1.0 if made[i][2] == k else -1.0 for k in sorted(count)] for i in known])
    penalty = np.eye(x.shape[1]) * 0.5
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(x[known].T @ (w * x[known]) + penalty, x[known].T @ (w * y))
    found = language.Presence(model.cells)
    got = model.values([t for _, t, _ in made], found, language.placed(model.used, model.cells))
    assert np.abs(got - x @ solved).max() < 0.05
    told = {r.doc_id: r for r in language.identify(df, model).collect()}
    held = [i for i, t, _ in made if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(told[i].lang_pred == sorted(count)[(x @ solved)[i].argmax()] for i in held)


def test_language_with_few_landmarks(spark):
    """Fewer landmarks than rows, one of them thinned: the regression on the kernel with just these, by dense algebra."""
    from tidewatch.llm import language

    rng = random.Random(16)
    made = []
    for i in range(120):
        letters = ("abcdef", "cdefgh")[i % 2]
        made.append((i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.choice((5, 30, 400)))), letters[0]))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(df, rows=1000, landmarks=16, ridge=0.5, mark_cells=900)
    found = language.Presence(model.cells)
    cells = [set(found.cells(t).tolist()) for _, t, _ in made]
    known = [i for i, _, _ in made if zlib.crc32(str(i).encode()) % 3 != 1]
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("lang", "text").alias("h")).collect()}
    marks = []
    for lang in "ac":
        first = sorted((i for i in known if made[i][2] == lang), key=lambda i: (hashes[i], made[i][1]))[:8]
        for i in first:
            c = sorted(cells[i])
            marks.append(set(c[:: -(-len(c) // 900)]))
    assert any(len(cells[i]) > 900 for i in known) and max(map(len, marks)) <= 900
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values[-1]
    x = np.hstack([kernel(cells, marks) @ vectors[:, keep] / np.sqrt(values[keep]), np.ones((len(made), 1))])
    w = np.array([len(known) / 2 / sum(made[j][2] == made[i][2] for j in known) for i in known])[:, None]
    y = np.array([[1.0 if made[i][2] == k else -1.0 for k in "ac"] for i in known])
    penalty = np.eye(x.shape[1]) * 0.5
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(x[known].T @ (w * x[known]) + penalty, x[known].T @ (w * y))
    got = model.values([t for _, t, _ in made], found, language.placed(model.used, model.cells))
    assert np.abs(got - x @ solved).max() < 0.01


# 7


def test_sharding(spark, docs, odd, tmp_path):
    from tidewatch.llm import shards

    store = shards.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, fan_in=4)
    assert store.append(docs.repartition(9)) == 1
    store.append(docs.limit(20))
    before = store.read().count()
    store.compact()
    assert store.read().count() == before == docs.count() + 20
    assert len(store.manifest()["shards"]) < len(store.manifest(2)["shards"])
    assert store.read(1).count() == docs.count()
    stale = store.manifest(1)
    with pytest.raises(shards.ManifestConflict):
        store._commit(stale, [], [], None)
    assert store.vacuum() > 0 and store.read().count() == before
    store._write(docs.limit(3))  # a writer that fails before its commit
    assert store.read().count() == before and len(store.orphans(-60)) == 1 and not store.orphans(3600)
    assert store.vacuum(orphans_s=-60) == 1 and store.read().count() == before
    for df in (odd, odd.limit(0)):
        assert rows(shards.sharded(df)) == rows(df)
    with pytest.raises(ValueError, match="extra, n_chars"):
        store.append(docs.drop("n_chars").withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="n_chars"):
        store.append(docs.withColumn("n_chars", F.col("n_chars").cast("string")))
    assert store.append(docs.select(*reversed(docs.columns)).limit(5)) and store.read().count() == before + 5


def test_sharding_merges_what_a_plain_plan_merges(spark, docs, tmp_path):
    from tidewatch.llm import shards

    store = shards.ShardStore(spark, str(tmp_path / "store"), target_bytes=400_000, fan_in=3)
    for n, files in enumerate(store.write_arrivals(docs.repartition(3), 8)):
        assert store.append_files(files, docs.schema) == n + 1
        assert len(store.manifest()["shards"]) == 3 * (n + 1)
    arrived = store.manifest()["shards"]
    assert store.full_tiers(store.manifest()) and len(arrived) == 24
    last = store.compact()
    seen = set()
    for v in range(1, last + 1):
        now, then = store.manifest(v), store.manifest(v - 1)
        paths = lambda m: {s["path"] for s in m["shards"]}
        gone, made = paths(then) - paths(now), paths(now) - paths(then)
        assert not made & seen  # files are never written again
        seen |= made
        assert store.read(v).count() == (docs.count() if v >= 8 else store.read(v).count())
        if gone:
            sizes = [s["bytes"] for s in then["shards"] if s["path"] in gone]
            assert len(made) < len(gone) >= 3 and len({store.tier(x) for x in sizes}) == 1 and max(sizes) < 200_000
    assert last > 8
    # what is left of a tier is too few to merge, or didn't get fewer by merging
    assert all(sum(s["bytes"] for s in v) > 200_000 for v in store.full_tiers(store.manifest()).values())
    assert rows(store.read()) == rows(docs)


def test_shard_versions_are_changes(spark, docs, tmp_path):
    """A version's file is as large as its change; bases give what the changes give, with or without vacuums."""
    import json

    from tidewatch.llm import shards

    few, root = docs.limit(5).coalesce(1).cache(), tmp_path / "store"
    store = shards.ShardStore(spark, str(root), target_bytes=1 << 20, fan_in=4, base_every=3, merge_most=5)
    model = []
    for _ in range(8):
        store.append(few)
        model.append({s["path"] for s in store.manifest()["shards"]})
    kept = root / "manifests"
    assert sorted(p.name for p in kept.glob("b*.json")) == ["b00000003.json", "b00000006.json"]
    sizes = [p.stat().st_size for p in sorted(kept.glob("v*.json"))]
    assert max(sizes[1:]) - min(sizes[1:]) < 10 and json.loads((kept / "v00000008.json").read_text())["schema"] is None
    for v, paths in enumerate(model, 1):
        assert {s["path"] for s in store.manifest(v)["shards"]} == paths and len(paths) == v
        assert store.read(v).count() == 5 * v
    # a lost base costs nothing but more reading
    (kept / "b00000006.json").unlink()
    assert [len(store.manifest(v)["shards"]) for v in range(9)] == list(range(9))
    assert [len(m) for m in store.merges(store.manifest())] == [5]  # eight of a tier, the other three wait
    last = store.compact()
    change = json.loads((kept / f"v{9:08d}.json").read_text())
    assert len(change["removed"]) == 5 and len(change["added"]) == 1
    # the file that they became is of the same tier as the three
    assert last == 10 and [len(store.manifest(v)["shards"]) for v in (8, 9, 10)] == [8, 4, 1]
    assert {store.read(v).count() for v in (8, 9, 10)} == {40}
    # two versions stay; a vacuum made again finds nothing
    assert store.vacuum(keep=2) == 5 and store.vacuum(keep=2) == 0 and store.versions() == [9, 10]
    assert [len(store.manifest(v)["shards"]) for v in (9, 10)] == [4, 1] and store.read(9).count() == 40
    with pytest.raises(ValueError, match="no version 8"):
        store.manifest(8)
    assert store.vacuum() == 4 and store.vacuum() == 0 and store.versions() == [10] and store.read().count() == 40
    assert not store.orphans(-60) and len(list((root / "data").rglob("*.parquet"))) == 1
    assert store.append(few) == 11 and store.read().count() == 45 and store.manifest()["schema"] == few.schema.json()


def test_sharding_of_two_writers(spark, docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidewatch.llm import shards

    stores = [shards.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, fan_in=4) for _ in range(4)]
    few = docs.limit(3).cache()
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda s: [s.append(few) for _ in range(3)], stores))
    assert sorted(v for each in versions for v in each) == list(range(1, 13))
    assert stores[0].read().count() == 36
    # a writer that merges what another has merged changes nothing
    plain = stores[1]._change

    def later(make, tries=20):
        stores[2].compact()
        return plain(make, tries)

    stores[1]._change = later
    stores[1].compact()
    assert stores[0].read().count() == 36 and not stores[0].orphans(-60)


# 8


def test_repeats(spark, docs):
    from tidewatch.llm import suffixes

    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(suffixes.repeats(docs)) == brute.repeats(given)
    assert rows(suffixes.repeats(docs, group_bytes=20_000, bucket_bytes=10_000)) == brute.repeats(given)


def test_repeats_small(spark, odd):
    from tidewatch.llm import suffixes

    rng = random.Random(3)
    made = [(None, None), (None, "x" * 200), (5, None), (6, ""), (7, "a" * 500), (3, "a" * 120), (3, "a" * 120), (4, "ab" * 300)]
    # rows that share an id with different texts, one of them a copy of an earlier document's
    alone = "nobody else has any of the words that stand in this text of its own " * 2
    made += [(90, alone), (90, "a" * 120), (90, "ab" * 300), (1, "the first of all, which the last one copies " * 3), (99, "the first of all, which the last one copies " * 3), (99, alone + "!")]
    made += [(None, "a" * 120)] * 30 + [(8, "y" * 49), (9, "y" * 50), (10, "y" * 50)]
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    for _ in range(60):
        t, u = rng.choice(base), rng.choice(base)
        a = rng.randrange(len(t))
        made.append((rng.randrange(100), t[a : rng.randrange(a, len(t) + 1)] + rng.choice(["", "x", "é"]) + u[rng.randrange(len(u)) :]))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(suffixes.repeats(df, group_bytes=3000, bucket_bytes=2000)) == brute.repeats(made)
    assert suffixes.repeats(df.limit(0)).count() == 0
    odd = odd.withColumn("__g", F.lit(1))
    cut = suffixes.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[5] == "" and kept[4] == "the same line of words " * 9 and kept[2] is None


def test_runs_of_a_key_are_in_one_order_for_all_orders_of_documents():
    from tidewatch.llm.suffixes import _distinct_runs, _group_keys

    shared = "a line that ends in one way or in another, as documents do"
    found = [(d, f"{x * 40} {shared} {x.upper() * 40}".encode()) for d, x in enumerate("bcdefg")]
    orders = []
    for given in (found, found[::-1], found[3:] + found[:3]):
        keys, _, each = _group_keys(given)
        runs = _distinct_runs(each, keys)
        orders.append({key: [(c, sorted((each[k][0], a) for k, a in places)) for c, places in contents.items()] for key, contents in runs.items()})
    assert max(map(len, orders[0].values())) > 1
    assert orders[0] == orders[1] == orders[2]


def test_repeats_on_several_executors(tmp_path):
    """Blocks of a shuffle come from other executors in any order, which differs between the looks at a group."""
    import json
    import subprocess
    import sys

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(20)]
    made = []
    for i in range(1600):
        t, u = rng.choice(base), rng.choice(base)
        a, b = rng.randrange(300), rng.randrange(300)
        made.append([i, t[a : a + rng.randint(55, 200)] + f" {i} " + u[b : b + rng.randint(55, 200)]])
    (tmp_path / "made.json").write_text(json.dumps(made))
    script = """
import json, sys
from pyspark.sql import SparkSession
folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.local.dir", folder + "/local").config("spark.checkpoint.dir", folder + "/shared").config("spark.sql.warehouse.dir", folder + "/warehouse")
    .getOrCreate()
)
from tidewatch.llm.suffixes import repeats
df = spark.createDataFrame(spark.sparkContext.parallelize(json.load(open(folder + "/made.json")), 16), "doc_id long, text string")
got = [[tuple(r) for r in repeats(df, group_bytes=100_000, bucket_bytes=50_000).collect()] for _ in range(2)]
json.dump(got, open(folder + "/got.json", "w"))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    want = brute.repeats([tuple(r) for r in made])
    for got in json.loads((tmp_path / "got.json").read_text()):
        assert sorted(map(tuple, got), key=repr) == want


def test_deep_shallow_finds_classes():
    from tidewatch.llm.suffixes import blind_trie, deep_shallow

    rng = random.Random(5)
    head = b"h" * 24
    tails = [bytes(rng.choice(b"ab") for _ in range(26)) for _ in range(6)]
    strings = [head + rng.choice(tails) if rng.random() < 0.7 else bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(300)]
    classes = deep_shallow(b"".join(strings), np.arange(len(strings)) * 50)
    count = Counter(strings)
    for i, s in enumerate(strings):
        assert (classes[i] >= 0) == (count[s] > 1)
        for j, t in enumerate(strings):
            if classes[i] >= 0:
                assert (classes[i] == classes[j]) == (s == t)
    found = blind_trie(strings)
    assert [strings[g[0]] for g in found] == sorted(count)
    assert all(strings[k] == strings[g[0]] for g in found for k in g)


# 9


def test_toxicity(spark, docs, odd):
    from tidewatch.llm import toxicity

    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    made = []
    for i in range(1500):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)] + (["vile", "awful"] if bad else [])
        rng.shuffle(text)
        made.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.classify(df, model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.98 * len(held)
    assert len(model.index) < 1 << 14
    told = toxicity.classify(odd, model).collect()
    assert len(told) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in told)
    none = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.classify(odd, none).collect()} == {0.5}
    assert set(toxicity.score(odd.withColumn("__scored", F.lit(1)), model).columns) == {*odd.columns, "__scored"}
    few = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), size=200_000)
    assert 0 < len(few.index) < len(model.index)


def test_toxicity_against_a_plain_pass():
    """The vectorised FTRL-proximal updates against the published ones, one coordinate at a time."""
    from tidewatch.llm import toxicity

    rng = np.random.default_rng(7)
    pairs = [(np.unique(rng.integers(0, 64, 12)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(400)]
    index, value, bias = toxicity.ftrl(iter(pairs), bits=6, alpha=0.7, beta=1.0, l1=0.5, l2=0.1)
    z, n, z0, n0 = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.5 else -(z[i] - math.copysign(0.5, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 0.1)

    for idx, y in pairs:
        w, w0 = {i: weight(i) for i in idx.tolist()}, -z0 / ((1.0 + math.sqrt(n0)) / 0.7)
        g = 1 / (1 + math.exp(-(sum(w.values()) + w0))) - y
        for i, wi in w.items():
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
            z[i] += g - s * wi
            n[i] += g * g
        s = (math.sqrt(n0 + g * g) - math.sqrt(n0)) / 0.7
        z0 += g - s * w0
        n0 += g * g
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert index.tolist() == sorted(want) and np.allclose(value, [want[i] for i in sorted(want)], atol=1e-5)
    assert bias == pytest.approx(-z0 / ((1.0 + math.sqrt(n0)) / 0.7))


# 10


@pytest.mark.parametrize("leaf", [8000, 40])
def test_simhash(spark, docs, odd, leaf, monkeypatch):
    from tidewatch.llm import simhash

    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    monkeypatch.setattr(simhash.near_pairs, "__kwdefaults__", simhash.near_pairs.__kwdefaults__ | {"leaf_rows": leaf})
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        prints = {r.doc_id: brute.simhash(r.text) for r in df.select("doc_id", "text").collect()}
        want = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_trees_lose_no_pair():
    from tidewatch.llm import simhash

    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
    fp = np.concatenate([a, a ^ flips])
    trees = [simhash.fit_tree(fp, 30, m, 1) for m in simhash.part_masks(3)]
    assert min(t.leaves for t in trees) > 4
    met = np.zeros(400, bool)
    for t in trees:
        where = defaultdict(set)
        for i, leaf in zip(*t.route(fp)):
            where[int(i)].add(int(leaf))
        met |= np.array([bool(where[k] & where[k + 400]) for k in range(400)])
    assert met.all()


def test_components_of_chains(spark):
    from tidewatch.llm.common import components

    rng = random.Random(1)
    nodes = list(range(1, 61))
    order = nodes[:]
    rng.shuffle(order)
    edges = list(zip(order[:30], order[1:30])) + list(zip(order[31:], order[32:])) + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in order[:30]} == {min(order[:30])}
    assert {got[n] for n in order[31:]} == {min(order[31:])}
    assert order[30] not in got
