"""Comparison of two models, agreement of annotators, and what training exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import reports, sampling
from tidewatch.plans.common import ORACLE_SQL, POSTS_SQL, posts, query
from tidewatch.sources.tables import duckdb_ctes, table

_PICK_SQL = """, {n} AS (SELECT post_id, polarity, greatest(positive, negative, neutral) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY predicted_at DESC) AS r FROM predictions WHERE model_version = 'model-{n}') WHERE r = 1)"""
_LABEL_SQL = """, {n} AS (SELECT post_id, polarity FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY labeled_at DESC) AS r FROM labels_log WHERE labeler = '{n}' AND version = '{v}' AND target IS NULL) WHERE r = 1)"""
_ALL = duckdb_ctes("posts_cdc", "predictions", "labels_log") + POSTS_SQL + _PICK_SQL.format(n="a") + _PICK_SQL.format(n="b")
_ALL += _LABEL_SQL.format(n="first", v="v2") + _LABEL_SQL.format(n="second", v="v1")
_ALL += """, pairs AS (
  SELECT p.post_id, p.board, coalesce(p.title, '') AS title, a.polarity AS polarity_a, a.score AS score_a, b.polarity AS polarity_b, b.score AS score_b, l.polarity AS label
  FROM posts p JOIN a ON a.post_id = p.post_id JOIN b ON b.post_id = p.post_id LEFT JOIN first l ON l.post_id = p.post_id WHERE NOT p.is_deleted)
, cross_check AS (SELECT post_id, f.polarity AS first, s.polarity AS second FROM first f JOIN second s USING (post_id))
"""
_KAPPA_SQL = """
count(*) AS n, count(*) FILTER (WHERE {a} = {b}) AS same, count(*) FILTER (WHERE {a} = 'positive') * count(*) FILTER (WHERE {b} = 'positive')
 + count(*) FILTER (WHERE {a} = 'negative') * count(*) FILTER (WHERE {b} = 'negative') + count(*) FILTER (WHERE {a} = 'neutral') * count(*) FILTER (WHERE {b} = 'neutral') AS chance"""
_KAPPA_OUT = "n, CASE WHEN n = 0 THEN 0 ELSE same / n END AS accuracy, CASE WHEN n = 0 THEN 0 WHEN n * n = chance THEN 1 ELSE (n * same - chance) / (n * n - chance) END AS kappa"


def model_choice(spark: SparkSession, sf_dir: str, version: str, name: str) -> DataFrame:
    """The newest prediction of a version for each post; class and score come from one row."""
    of = table(spark, sf_dir, "predictions").where(F.col("model_version") == version)
    pick = F.max_by(F.struct("polarity", F.greatest("positive", "negative", "neutral").alias("score")), "predicted_at")
    return of.groupBy("post_id").agg(pick.alias("p")).select("post_id", F.col("p.polarity").alias(f"polarity_{name}"), F.col("p.score").alias(f"score_{name}"))


def whole_post_label(spark: SparkSession, sf_dir: str, labeler: str, version: str, name: str) -> DataFrame:
    """The newest label of whole posts by one annotator and version."""
    of = table(spark, sf_dir, "labels_log").where((F.col("labeler") == labeler) & (F.col("version") == version) & F.col("target").isNull())
    return of.groupBy("post_id").agg(F.max_by("polarity", "labeled_at").alias(name))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = posts(spark, sf_dir).where(~F.col("is_deleted")).select("post_id", "board", F.coalesce("title", F.lit("")).alias("title"))
    both = live.join(model_choice(spark, sf_dir, "model-a", "a"), "post_id").join(model_choice(spark, sf_dir, "model-b", "b"), "post_id")
    return both.join(whole_post_label(spark, sf_dir, "first", "v2", "label"), "post_id", "left")


def cross_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = whole_post_label(spark, sf_dir, "first", "v2", "first")
    return first.join(whole_post_label(spark, sf_dir, "second", "v1", "second"), "post_id")


@query(_ALL + "SELECT * FROM pairs")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


_GRID = "(VALUES ('positive'), ('negative'), ('neutral'))"


@query(_ALL + f"SELECT t.c AS truth, g.c AS guess, count(p.post_id) AS n FROM {_GRID} t(c) CROSS JOIN {_GRID} g(c) LEFT JOIN pairs p ON p.label = t.c AND p.polarity_a = g.c GROUP BY ALL")
def model_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(pairs(spark, sf_dir), "label", "polarity_a")


@query(_ALL + f"SELECT {_KAPPA_OUT} FROM (SELECT {_KAPPA_SQL.format(a='polarity_a', b='polarity_b')} FROM pairs)")
def model_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.agreement(pairs(spark, sf_dir), "polarity_a", "polarity_b")


@query(_ALL + f"SELECT board, {_KAPPA_OUT} FROM (SELECT board, {_KAPPA_SQL.format(a='polarity_a', b='polarity_b')} FROM pairs GROUP BY board)")
def model_kappa_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.agreement(pairs(spark, sf_dir), "polarity_a", "polarity_b", ["board"])


def _f1_sql(of: str, by: str) -> str:
    one = lambda c: f"CASE WHEN count(*) FILTER (WHERE label = '{c}') + count(*) FILTER (WHERE {of} = '{c}') = 0 THEN 0 ELSE 2 * count(*) FILTER (WHERE label = '{c}' AND {of} = '{c}') / (count(*) FILTER (WHERE label = '{c}') + count(*) FILTER (WHERE {of} = '{c}')) END AS f1_{c}"
    inner = f"SELECT {by}{', '.join(map(one, stats.CLASSES))} FROM pairs WHERE label IS NOT NULL {'GROUP BY board' if by else ''}"
    return _ALL + f"SELECT *, (f1_positive + f1_negative + f1_neutral) / 3 AS macro_f1 FROM ({inner})"


@query(_f1_sql("polarity_a", ""))
def model_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.f1_scores(pairs(spark, sf_dir).where("label IS NOT NULL"), "label", "polarity_a")


@query(_f1_sql("polarity_b", "board, "))
def model_f1_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.f1_scores(pairs(spark, sf_dir).where("label IS NOT NULL"), "label", "polarity_b", ["board"])


@query(_ALL + """
SELECT t AS threshold, count(*) FILTER (WHERE score_b < t) / count(*) AS below, count(*) FILTER (WHERE score_b >= t AND label IS NOT NULL) AS n,
  count(*) FILTER (WHERE score_b >= t AND label = polarity_b) / nullif(count(*) FILTER (WHERE score_b >= t AND label IS NOT NULL), 0) AS accuracy
FROM pairs, (VALUES (0.4::DOUBLE), (0.5), (0.6), (0.7)) AS x(t) GROUP BY t""")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = pairs(spark, sf_dir).withColumn("right", F.col("label") == F.col("polarity_b"))
    return stats.confidence_buckets(told, "score_b", "right", (0.4, 0.5, 0.6, 0.7))


_LATENCY_SQL = duckdb_ctes("posts_cdc", "predictions") + """
, latency AS (SELECT pr.post_id, (epoch_us(first_at) - epoch_us(created)) / 1e6 AS latency_s
  FROM (SELECT post_id, min(predicted_at) AS first_at FROM predictions WHERE model_version = 'model-a' GROUP BY 1) pr
  JOIN (SELECT post_id, min(changed_at) AS created FROM posts_cdc WHERE op = 'c' GROUP BY 1) h ON h.post_id = pr.post_id)
"""  # fmt: skip


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from a post's creation to its first prediction."""
    first = table(spark, sf_dir, "predictions").where("model_version = 'model-a'").groupBy("post_id").agg(F.min("predicted_at").alias("first_at"))
    made = table(spark, sf_dir, "posts_cdc").where("op = 'c'").groupBy("post_id").agg(F.min("changed_at").alias("created"))
    return first.join(made, "post_id").select("post_id", ((F.unix_micros("first_at") - F.unix_micros("created")) / 1e6).alias("latency_s"))


@query(_LATENCY_SQL + "SELECT * FROM latency")
def inference_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latencies(spark, sf_dir)


@query(_LATENCY_SQL + "SELECT count(*) AS n, coalesce(quantile_cont(latency_s, 0.5), 0) AS p50, coalesce(quantile_cont(latency_s, 0.95), 0) AS p95, coalesce(max(latency_s), 0) AS max FROM latency")
def inference_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latencies(spark, sf_dir).agg(
        F.count("*").alias("n"), stats.interpolated("latency_s", 0.5).alias("p50"), stats.interpolated("latency_s", 0.95).alias("p95"),
        F.coalesce(F.max("latency_s"), F.lit(0.0)).alias("max"),
    )


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(stats.nearest_rank("value", 0.5).alias("p50"), stats.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)) WHERE r = n // 2 + 1")
def percentile_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])


_RATIO_SQL = _ALL + """, ratios AS (
  SELECT p.post_id, p.board, l.polarity, CASE l.polarity WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS level, push_count / (push_count + boo_count)::DOUBLE AS ratio
  FROM first l JOIN posts p USING (post_id) WHERE push_count + boo_count >= 10)
"""  # fmt: skip


def push_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts with ten votes or more, their share of pushes and their class as a level."""
    joined = posts(spark, sf_dir).join(whole_post_label(spark, sf_dir, "first", "v2", "polarity"), "post_id").where("push_count + boo_count >= 10")
    level = F.when(F.col("polarity") == "negative", -1).when(F.col("polarity") == "neutral", 0).otherwise(1)
    return joined.select("post_id", "board", "polarity", level.alias("level"), (F.col("push_count") / (F.col("push_count") + F.col("boo_count"))).alias("ratio"))


@query(_RATIO_SQL + "SELECT polarity, count(*) AS n, quantile_cont(ratio, 0.25) AS p25, quantile_cont(ratio, 0.5) AS median, quantile_cont(ratio, 0.75) AS p75 FROM ratios GROUP BY polarity")
def quartiles_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = push_ratios(spark, sf_dir).groupBy("polarity").agg(F.count("*").alias("n"), F.expr("percentile(ratio, array(0.25, 0.5, 0.75))").alias("q"))
    return q.select("polarity", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))])


@query(_RATIO_SQL + """, ranked AS (SELECT board, (2 * rank() OVER (PARTITION BY board ORDER BY ratio) + count(*) OVER (PARTITION BY board, ratio) - 1) / 2.0 AS x,
  (2 * rank() OVER (PARTITION BY board ORDER BY level) + count(*) OVER (PARTITION BY board, level) - 1) / 2.0 AS y FROM ratios)
SELECT board, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS rho FROM ranked GROUP BY board""")
def spearman_push_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(push_ratios(spark, sf_dir), "ratio", "level", ["board"])


@query(_ALL + f"SELECT {_KAPPA_OUT} FROM (SELECT {_KAPPA_SQL.format(a='first', b='second')} FROM cross_check)")
def label_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.agreement(cross_checked(spark, sf_dir), "first", "second")


@query(_ALL + "SELECT c.post_id, first, second, coalesce(title, '') AS title FROM cross_check c JOIN posts p ON p.post_id = c.post_id WHERE first <> second")
def label_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts on which the annotators differ, ready for a spreadsheet."""
    from tidewatch.functions.expressions import csv_safe

    title = csv_safe(F.coalesce("title", F.lit(""))).alias("title")
    named = posts(spark, sf_dir).select("post_id", title)
    return cross_checked(spark, sf_dir).where("first <> second").join(named, "post_id")


_TESTSET_SQL = """, testset AS (SELECT post_id, board FROM (SELECT post_id, board, row_number() OVER (PARTITION BY board ORDER BY md5(post_id || ':300'), post_id) AS r
  FROM posts WHERE NOT is_deleted AND strlen(coalesce(content, '')) >= 6) WHERE r <= 20)
"""
_EXPORT_SQL = _ALL + _TESTSET_SQL + """, export AS (SELECT p.post_id, p.board, coalesce(p.title, '') AS title, f.polarity FROM first f JOIN posts p ON p.post_id = f.post_id
  WHERE NOT p.is_deleted AND p.post_id NOT IN (SELECT post_id FROM testset) AND p.post_id NOT IN (SELECT post_id FROM cross_check WHERE first <> second))
"""  # fmt: skip


def testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty posts a board of some length in bytes, in an order hashed from a seed."""
    fine = posts(spark, sf_dir).where(~F.col("is_deleted") & (F.octet_length(F.coalesce("content", F.lit(""))) >= 6))
    return sampling.stratified(fine, ["board"], "post_id", 20, 300)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled live posts outside the test set on which the annotators don't differ."""
    kept = posts(spark, sf_dir).where(~F.col("is_deleted")).select("post_id", "board", F.coalesce("title", F.lit("")).alias("title"))
    kept = kept.join(whole_post_label(spark, sf_dir, "first", "v2", "polarity"), "post_id").join(testset(spark, sf_dir), "post_id", "left_anti")
    return kept.join(cross_checked(spark, sf_dir).where("first <> second"), "post_id", "left_anti")


@query(_EXPORT_SQL + "SELECT * FROM export")
def export_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir)


@query(_EXPORT_SQL + f"SELECT t.c AS polarity, count(e.post_id) AS n FROM {_GRID} t(c) LEFT JOIN export e ON e.polarity = t.c GROUP BY t.c")
def export_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.struct(F.lit(c).alias("polarity"), F.count_if(F.col("polarity") == c).alias("n")) for c in stats.CLASSES]
    return exported(spark, sf_dir).agg(F.array(*made).alias("rows")).select(F.inline("rows"))


@query(_EXPORT_SQL + "SELECT post_id, polarity, row_number() OVER (PARTITION BY polarity ORDER BY md5(post_id || ':20261007'), post_id) <= ceil(count(*) OVER (PARTITION BY polarity) * 0.1) AS validation FROM export")
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_share(exported(spark, sf_dir).select("post_id", "polarity"), ["polarity"], "post_id", 0.1, 20261007)


@query(_EXPORT_SQL + "SELECT polarity, count(*) AS n, (SELECT count(*) FROM export) / ((SELECT count(DISTINCT polarity) FROM export) * count(*)) AS weight FROM export GROUP BY polarity")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that make the classes count alike: n / (classes * class n)."""
    counts = exported(spark, sf_dir).groupBy("polarity").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over one row a class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


@query(_ALL + _TESTSET_SQL + "SELECT post_id, board FROM testset")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testset(spark, sf_dir).select("post_id", "board")


@query(_ALL + _TESTSET_SQL + "SELECT board, count(*) AS n, count(*) >= 20 AS enough FROM testset GROUP BY board")
def testset_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testset(spark, sf_dir).groupBy("board").agg(F.count("*").alias("n"), (F.count("*") >= 20).alias("enough"))


@query(_ALL + "SELECT post_id, board FROM posts WHERE NOT is_deleted AND post_id NOT IN (SELECT post_id FROM labels_log WHERE labeler = 'second') ORDER BY md5(post_id || ':7'), post_id LIMIT 100")
def unlabelled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred posts that an annotator hasn't seen, in hash order over all boards."""
    seen = table(spark, sf_dir, "labels_log").where("labeler = 'second'").select("post_id")
    fresh = posts(spark, sf_dir).where(~F.col("is_deleted")).join(seen, "post_id", "left_anti")
    return fresh.orderBy(sampling.hash_order(F.col("post_id"), 7), "post_id").limit(100).select("post_id", "board")


@query(_ALL + _TESTSET_SQL + """SELECT board, min(post_id) FILTER (WHERE l.post_id IS NULL) AS next_post, count(l.post_id) AS done, count(*) AS total
FROM testset t LEFT JOIN (SELECT DISTINCT post_id FROM labels_log WHERE labeler = 'second') l USING (post_id) GROUP BY board""")
def annotation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By board the first test post without a label of the annotator, and how far they are."""
    done = table(spark, sf_dir, "labels_log").where("labeler = 'second'").select("post_id").distinct().withColumn("done", F.lit(True))
    joined = testset(spark, sf_dir).join(done, "post_id", "left")
    return joined.groupBy("board").agg(
        F.min(F.when(F.col("done").isNull(), F.col("post_id"))).alias("next_post"), F.count("done").alias("done"), F.count("*").alias("total")
    )


@query()
def stream_sample_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable twentieth of the posts by checksum of the id; DuckDB has no CRC-32."""
    return posts(spark, sf_dir).where(sampling.in_percent(F.col("post_id"), 5)).select("post_id")


def _stacked_sql(section: str, scope: str, measures: str, sql: str) -> str:
    cells = ", ".join(f"{{'measure': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in measures.split())
    return f"SELECT '{section}' AS section, {scope} AS scope, unnest([{cells}], recursive := true) FROM ({sql})"


_AGREE, _F1 = "n accuracy kappa", "f1_positive f1_negative f1_neutral macro_f1"
_BUCKETS_SQL = ORACLE_SQL["confidence_buckets"]
_BY_BOARD_SQL = _ALL + f"SELECT board, t.c AS truth, g.c AS guess, count(*) FILTER (WHERE polarity_a = t.c AND polarity_b = g.c) AS n FROM pairs, {_GRID} t(c), {_GRID} g(c) GROUP BY ALL"
_LABELS_SQL = _ALL + f"SELECT {_KAPPA_OUT} FROM (SELECT {_KAPPA_SQL} FROM pairs WHERE label IS NOT NULL)"
_COMPARED = [
    ("agreement", "'all'", _AGREE, ORACLE_SQL["model_kappa"]), ("agreement", "board", _AGREE, ORACLE_SQL["model_kappa_by_board"]),
    ("confusion", "'all/' || truth || '/' || guess", "n", f"SELECT truth, guess, sum(n) AS n FROM ({_BY_BOARD_SQL}) GROUP BY ALL"),
    ("confusion", "board || '/' || truth || '/' || guess", "n", _BY_BOARD_SQL),
    ("latency", "'a'", "n p50 p95 max", ORACLE_SQL["inference_latency_summary"]),
    ("confidence", "'b/' || threshold", "below n accuracy", _BUCKETS_SQL),
    ("confidence", "'a/' || threshold", "below n accuracy", _BUCKETS_SQL.replace("score_b", "score_a").replace("polarity_b)", "polarity_a)")),
    *[("labels", f"'{m}'", _AGREE, _LABELS_SQL.format(a="label", b=f"polarity_{m}")) for m in "ab"],
    *[("f1", f"'{m}'", _F1, _f1_sql(f"polarity_{m}", "")) for m in "ab"],
]


@query(" UNION ALL ".join(_stacked_sql(*s) for s in _COMPARED))
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the report that compares two models."""
    seconds = latencies(spark, sf_dir).withColumn("model", F.lit("a"))
    return reports.stacked(reports.comparison(pairs(spark, sf_dir), seconds))


_EVALUATED = [
    ("posts", "'all'", "n few", _ALL + "SELECT count(*) AS n, 0 AS few FROM pairs WHERE label IS NOT NULL"),
    ("posts", "board", "n few", _ALL + "SELECT board, count(*) AS n, (count(*) < 30)::INT AS few FROM pairs WHERE label IS NOT NULL GROUP BY board"),
    ("f1", "'all'", _F1, _f1_sql("polarity_b", "")), ("f1", "board", _F1, _f1_sql("polarity_b", "board, ")),
    ("confusion", "truth || '/' || guess", "n", ORACLE_SQL["model_confusion"].replace("polarity_a = g.c", "polarity_b = g.c")),
    ("annotators", "'all'", _AGREE, _ALL + f"SELECT {_KAPPA_OUT} FROM (SELECT {_KAPPA_SQL.format(a='first', b='second')} FROM cross_check)"),
]


@query(" UNION ALL ".join(_stacked_sql(*s) for s in _EVALUATED))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the report on one model against the labels."""
    return reports.stacked(reports.evaluation(pairs(spark, sf_dir), "polarity_b", cross_checked(spark, sf_dir)))


@query(" UNION ALL ".join([_stacked_sql("quartiles", "polarity", "n p25 median p75", ORACLE_SQL["quartiles_by_class"]), _stacked_sql("correlation", "board", "n rho", ORACLE_SQL["spearman_push_ratio"])]))
def push_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the report on votes and classes."""
    return reports.stacked(reports.push_ratio(push_ratios(spark, sf_dir)))
