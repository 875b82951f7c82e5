"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the same line of words comes again "
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, LINE * 9, "en", "a", 15), (3, " \n\t\v\f\r ", "en", None, 4), (10, None, "en", "a", 0),
    (4, LINE * 9, "en", "a", 1), (4, LINE * 9, "en", "a", 1), (6, "été \x1c   " * 9_000, "fr", "b", 1), (7, "12 34 --", "de", "c", 8),
    (8, "no  space\tat the ends", "en", "c", 21), (35, "ha " * 23, "en", "c", 1), (36, "ha " * 24, "en", "c", 1), (40, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    return given.unionByName(spark.createDataFrame(ODD, DOCS)).withColumns({c: F.lit(1) for c in ("runs", "row", "k", "ids", "start", "h", "w")})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11


def plain_runs(w, least=24, times=3):
    """(start, length, period) by comparing every word with the one a period on."""
    number = {x: i for i, x in enumerate(w)}
    x, found = np.array([number[y] for y in w]), {}
    for p in range(1, len(w) // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], x[:-p] == x[p:], [0]]))).tolist()
        for i, j in zip(edges[::2], edges[1::2]):
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    from tidewatch.llm.periods import collapsed, find_runs

    rng = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
                w += rng.choice(([rng.choice("abcdef") for _ in range(rng.randint(0, 40))], unit * rng.randint(1, 8) + unit[: rng.randint(0, 9)], ["x"] * rng.randint(0, 50)))
            texts.append([x.encode() for x in w])
        for least, times in ((24, 3), (4, 2), (9, 5)):
            for w, got in zip(texts, find_runs(texts, least, times)):
                want = plain_runs(w, least, times)
                assert list(map(tuple, got.tolist())) == want
                gone = {i for s, n, p in want for i in range(s + p, s + n)}
                assert collapsed(w, got) == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_suffix_arrays_and_extensions():
    from tidewatch.llm.periods import RangeMin, Suffixes

    rng = np.random.default_rng(4)
    for n, kinds in ((1, 2), (2, 1), (100, 2), (333, 1), (700, 3)):
        x = rng.integers(0, kinds, n)
        s = Suffixes(x)
        assert sorted(range(n), key=lambda i: x[i:].tolist()) == np.argsort(s.rank).tolist()
        for a, b in rng.integers(0, n, (50, 2)):
            if a != b:
                same = next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n)
                assert s.extension(np.array([a]), np.array([b]))[0] == same
        least = RangeMin(x)
        low = rng.integers(0, n, 200)
        high = np.minimum(low + rng.integers(0, n, 200), n - 1)
        assert least(low, high).tolist() == [x[i : j + 1].min() for i, j in zip(low, high)]


def planted(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


def digest(b):
    return hashlib.sha256(b).hexdigest()


def plain_digests(i, text):
    w = planted(i, text)
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *own, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(kept))


def test_runs_query(spark, docs, tmp_path):
    from tidewatch.llm.queries import op11_periodic_runs

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert rows(got) == sorted((plain_digests(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r.n_runs > 0 for r in got.collect()) > 20
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op11_periodic_runs(spark, str(tmp_path / "none")).count() == 0


def test_runs_operator(docs):
    from tidewatch.llm.periods import periodic_runs

    got = {(r.doc_id, r.n_words): r for r in periodic_runs(docs).collect()}
    assert got[4, 63].collapsed == LINE.strip() and [tuple(r) for r in got[4, 63].runs] == [(0, 63, 7)]
    assert got[None, 63].collapsed == LINE.strip() and got[2, 0].collapsed == "" and got[3, 0].runs == []
    assert got[35, 23].runs == [] and tuple(got[36, 24].runs[0]) == (0, 24, 1)


# 12


@pytest.fixture(scope="module")
def byte_vocabulary():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LONG = [
    "word and another, isn't it? we'll see  \n\n  the end 123 4567 " * 40, "汉字，没有空格。" * 300, "a" * 3000, " " * 3000 + "x", "'s'll've" * 400, "x" * 500 + " " * 700 + "y's " * 90,
    "naïve café ́​😀 1٣½ \x1c\x85 " * 60, "\U00016ea7\U0001df67's abc" * 90, "don''t " * 300, "-=" * 900 + "end", "\n" * 2000, "<|endoftext|> " * 99,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 10), (200, 40), (64, 8), (37, 11)])
def test_byte_bpe(spark, docs, byte_vocabulary, chunk, overlap):
    from tidewatch.llm.bytepairs import decode, encode

    path, pattern, plain = byte_vocabulary
    texts = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(LONG)], DOCS), allowMissingColumns=True)
    if chunk < 100:
        texts = texts.where("doc_id >= 100 OR doc_id % 4 = 1 OR doc_id IS NULL")
    coded = encode(texts, path, pattern, chunk=chunk, overlap=overlap).cache()
    want = {}
    for r in texts.select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, []).append((len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
    got = {}
    for r in decode(coded.withColumn("again", F.col("ids")).withColumn("a.b", F.lit(1)), path, pattern).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, bytes(r.again), bytes(r.decoded)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    coded.unpersist()


def test_byte_bpe_beyond_the_library(byte_vocabulary):
    from tidewatch.llm.bytepairs import codec

    own = codec(*byte_vocabulary[:2])
    text = " " * 1_500_000 + "x"
    assert own.decode(own.encode(text)) == text.encode()


def test_byte_bpe_empty(spark, docs, byte_vocabulary):
    from tidewatch.llm.bytepairs import decode, encode

    coded = encode(docs.limit(0), *byte_vocabulary[:2])
    assert coded.count() == 0 and decode(coded, *byte_vocabulary[:2]).columns == ["doc_id", "n_tokens", "decoded"]
    assert decode(spark.createDataFrame([(None,)], "ids binary"), *byte_vocabulary[:2]).collect()[0].decoded is None


# 13


def plain_codes(given):
    """(vec_id, code, error, label_error, sha) by comparing every part with every entry."""
    kept = [(i, v, label) for i, v, label in given if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[max(-(1 << 24), min(1 << 24, math.floor(1024 * c))) for c in v] for _, v, _ in kept]).reshape(len(kept), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()

    def assign(k):
        apart = ((x[:, k, None] - books[k]) ** 2).sum(axis=2)
        return apart.argmin(axis=1), apart.min(axis=1)

    for _ in range(4):
        for k in range(4):
            index, _ = assign(k)
            for e in set(index.tolist()):
                own = x[index == e, k]
                books[k, e] = own.sum(axis=0) // len(own)
    found = [assign(k) for k in range(4)]
    errors = sum(apart for _, apart in found).tolist()
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    sha = digest(",".join(map(str, books.ravel().tolist())).encode())
    codes = ["".join(f"{index[j]:02x}" for index, _ in found) for j in range(len(kept))]
    return sorted(((i, c, e, total[label], sha) for (i, _, label), c, e in zip(kept, codes, errors)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_codes(spark, tmp_path):
    from tidewatch.llm.queries import op13_vector_codes

    rng = np.random.default_rng(5)
    many = [(int(i), (rng.integers(-3, 4, 8) / 8).tolist(), int(i) % 3 or None) for i in rng.permutation(700)]
    odd = [
        (900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [float("-inf")] * 8, 1), (905, [0.5] * 12, 1), (906, [0.5] * 7, 1),
        (None, [0.25] * 8, None), (5, [0.25] * 8, 2), (5, [0.25] * 8, 2), (907, [1e30, -1e30] * 4, 7), (908, [-1e-9] * 8, 7),
    ]
    for name, given in (("many", many + odd), ("few", [(2, [0.5] * 8, 1), (1, [0.5] * 8, 1), (3, [-0.5] * 8, None)]), ("none", odd[:5])):
        df = spark.createDataFrame(given, VECTORS).withColumns({c: F.lit("x") for c in ("code", "error", "of", "v", "id")})
        df.repartition(5).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = op13_vector_codes(spark, str(tmp_path / name))
        assert rows(got) == (plain_codes(given) if name != "none" else [])
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_kd_tree_prefers_the_lowest_index():
    from tidewatch.llm.codes import KdTree

    rng = np.random.default_rng(6)
    for size, dims, span in ((1, 3, 5), (256, 2, 3), (256, 16, 40), (100, 5, 1)):
        entries, queries = rng.integers(-span, span + 1, (size, dims)), rng.integers(-span, span + 1, (500, dims))
        index, apart = KdTree(entries).nearest(queries)
        plain = ((queries[:, None] - entries) ** 2).sum(axis=2)
        assert (index == plain.argmin(axis=1)).all() and (apart == plain.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_vector_codes"])
def test_against_duckdb(spark, name):
    import duckdb
    from tidewatch.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(queries.QUERIES[name](spark, SMALL).select(names)) == sorted(want.fetchall(), key=repr)
