"""The queries of the training-data operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import licenses


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images in archives, and what reading these back gives."""
    from tidewatch.llm.media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of one label at a cosine of 0.98."""
    from tidewatch.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated so that sources weigh the square roots of their sizes."""
    from tidewatch.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    from tidewatch.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt outside the held-out fold."""
    from tidewatch.llm.language import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op7_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards, compacted, and read back through the manifest."""
    from tidewatch.llm.shards import sharded

    return sharded(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 50-byte strings leaves of all documents."""
    from tidewatch.llm.suffixes import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labelled rows outside the held-out fold."""
    from tidewatch.llm.toxicity import classify, train

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that their links make."""
    from tidewatch.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten by its id's hash repeats a stretch of its words from some word on to its end."""
    words = F.array_remove(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), "")
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    told = told.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    told = told.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), 1, F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a")), again), " ")
    return told.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, some of which are made to repeat themselves, and what collapsing them leaves."""
    from tidewatch.llm.periods import periodic_runs

    found = periodic_runs(planted_repeats(_table(spark, sf_dir, "documents")))
    # runs stand by start, then period, so that only a larger exponent replaces an earlier run
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x.length * a.period > a.length * x.period, x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x.start, x.length, x.period), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        *[F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a multilingual byte-level vocabulary and decoded again."""
    import public_tokenizers

    from tidewatch.llm.bytepairs import decode, encode

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(_table(spark, sf_dir, "documents"), path, pattern).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(coded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Labels whose errors are broadcast, at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings as four bytes each, their errors, and their labels' errors."""
    from tidewatch.llm import codes
    from tidewatch.llm.common import written

    vectors = _table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(codes.encode(vectors, books, keep=["vec_id", "label"]), "codes")
    # the sums of one label are combined before they are shuffled, and written, as their number is looked at
    total = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    if total.count() <= BROADCAST_LABELS:
        total = F.broadcast(total)
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_size_tiered_sharding": op7_size_tiered_sharding,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_vector_codes": op13_vector_codes,
}

#: As many Poisson terms as the largest rate needs, by their logarithms, so that large rates don't underflow.
_MIXING_SQL = """
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * weight / (SELECT sum(weight) FROM counts) / n AS rate FROM counts
),
reach AS (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 40)::BIGINT AS most FROM rates),
terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p FROM rates, (SELECT unnest(range(0, most)) AS k FROM reach)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
keyed AS (
  SELECT d.*, '7:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, ''))) AS key FROM documents d
),
draws AS (SELECT *, ('0x' || substr(md5(key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM keyed),
dealt AS (
  SELECT d.r, d.doc_id, d.text, d.lang, d.source, d.n_chars, d.key, count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM (SELECT *, row_number() OVER () AS r FROM draws) d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5(key || ':' || copy::VARCHAR) AS shuffle_key
FROM dealt, range(1, n + 1) AS r(copy)
"""

#: Runs as stretches without a mismatch one period on; periods come from grid points before equal nine words.
_RUNS_SQL = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS bytes(i)
  )
),
told AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
    )) AS h
  FROM documents, crc
),
aimed AS (
  SELECT r, doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS made, CASE WHEN len(o) > 0 THEN h // 10 % len(o) END AS a, h // 10 AS g FROM told
),
given AS (
  SELECT r, doc_id, n, CASE WHEN made THEN
    list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE o END AS w
  FROM aimed
),
grams AS (SELECT r, n, list_transform(range(n - 8), lambda i: hash(w[i + 1 : i + 9])) AS g FROM given WHERE n >= 24),
periods AS (
  SELECT r, p FROM (SELECT r, n, g, unnest(range(1, n // 3 + 1)) AS p FROM grams WHERE len(list_distinct(g)) < len(g))
  WHERE len(list_filter(range(0, (n - 9) // p), lambda j: g[j * p + 1] = g[(j + 1) * p + 1])) > 0
),
breaks AS (
  SELECT r, p, list_concat([-1], list_filter(range(n - p), lambda i: w[i + 1] <> w[i + p + 1]), [n - p]) AS m FROM periods JOIN given USING (r)
),
stretches AS (
  SELECT r, p, m[k] + 1 AS start, m[k + 1] - m[k] - 1 + p AS length FROM (SELECT r, p, m, unnest(range(1, len(m))) AS k FROM breaks)
),
runs AS (SELECT r, start, length, min(p) AS period FROM stretches WHERE length >= greatest(24, 3 * p) GROUP BY r, start, length),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs),
best AS (SELECT * FROM ranked WHERE k = 1),
lines AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY r
),
gone AS (SELECT r, list_distinct(flatten(list(range(start + period, start + length)))) AS g FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM given SEMI JOIN runs USING (r))
  ANTI JOIN (SELECT r, unnest(g) AS i FROM gone) USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256,
  sha256(coalesce(t, array_to_string(w, ' '))) AS collapsed_sha256
FROM given LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of nearest entries, each entry compared with each part, and of means."""
    made = ["""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(least(greatest(1024 * x::DOUBLE, -16777216), 16777216))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 4 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
alike AS (SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept WHERE r = 1)),
parts AS (
  SELECT r, k, x, list_inner_product(x, x) AS square
  FROM (SELECT r, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS x FROM alike, range(4) AS part(k))
),
book0 AS (SELECT k, r - 1 AS e, x FROM parts WHERE r <= 256)"""]  # fmt: skip
    for i in range(rounds + 1):
        made.append(f"""
near{i} AS (
  SELECT r, k, min(struct_pack(d := square - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), e := e)) AS m
  FROM parts AS p JOIN book{i} AS b USING (k) GROUP BY r, k
)""")
        if i < rounds:
            made.append(f"""
book{i + 1} AS (
  SELECT k, e, coalesce(means.x, b.x) AS x FROM book{i} AS b LEFT JOIN (
    SELECT k, e, list(mean ORDER BY pos) AS x FROM (
      SELECT k, e, pos, floor(sum(x) / count(*)) AS mean
      FROM (SELECT k, m.e AS e, unnest(x) AS x, unnest(range(len(x))) AS pos FROM parts JOIN near{i} USING (r, k)) GROUP BY k, e, pos
    ) GROUP BY k, e
  ) AS means USING (k, e)
)""")
    return f"""WITH {",".join(made)},
coded AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY k, e)) FROM book{rounds}) AS codebooks_sha256
FROM alike JOIN coded USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": _MIXING_SQL,
    "op5_license_scan": licenses.oracle_sql(),
    "op7_size_tiered_sharding": "SELECT * FROM documents",
    "op11_periodic_runs": _RUNS_SQL,
    "op13_vector_codes": _codes_sql(),
}
