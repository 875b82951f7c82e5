"""Rules for messages and labels, watchdogs, and counts of what was set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import watch
from tidewatch.plans.common import POSTS_SQL, posts, query
from tidewatch.sources.tables import duckdb_ctes, table


@query(duckdb_ctes("predictions") + """
, q AS (SELECT post_id, predicted_at, polarity, negative, neutral, CASE WHEN second(predicted_at) % 9 = 0 THEN positive + 0.1::DOUBLE ELSE positive END AS positive, CASE WHEN text_hash = '' THEN '' ELSE text_hash || text_hash END AS h FROM predictions)
SELECT post_id, predicted_at, CASE WHEN abs(positive + negative + neutral - 1) > 0.001::DOUBLE THEN 'sum' WHEN polarity <> CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END THEN 'polarity'
  WHEN NOT regexp_full_match(h, '[0-9a-f]{64}') THEN 'hash' END AS rule FROM q""")
def prediction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each prediction breaks: scores add up to 1, the class has the largest, the hash is one."""
    shifted = F.when(F.second("predicted_at") % 9 == 0, F.col("positive") + F.lit(0.1)).otherwise(F.col("positive"))
    q = table(spark, sf_dir, "predictions").withColumn("positive", shifted)
    q = q.withColumn("h", F.when(F.col("text_hash") == "", "").otherwise(F.concat("text_hash", "text_hash")))
    # the order of the classes settles ties
    best = F.greatest("positive", "negative", "neutral")
    top = F.when(F.col("positive") == best, "positive").when(F.col("negative") == best, "negative").otherwise("neutral")
    rule = (
        F.when(F.abs(F.col("positive") + F.col("negative") + F.col("neutral") - 1) > 0.001, "sum")
        .when(F.col("polarity") != top, "polarity")
        .when(~F.col("h").rlike("^[0-9a-f]{64}$"), "hash")
    )
    return q.select("post_id", "predicted_at", rule.alias("rule"))


@query(duckdb_ctes("labels_log") + """
SELECT post_id, labeler, version, CASE WHEN count(*) FILTER (WHERE target IS NULL) <> 1 THEN 'whole' WHEN count(target) <> count(DISTINCT target) THEN 'target' END AS rule FROM labels_log GROUP BY ALL""")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of sentiments need exactly one for the whole post and distinct targets."""
    got = table(spark, sf_dir, "labels_log").groupBy("post_id", "labeler", "version")
    rule = F.when(F.count_if(F.col("target").isNull()) != 1, "whole").when(F.count("target") != F.countDistinct("target"), "target")
    return got.agg(rule.alias("rule"))


@query(duckdb_ctes("labels_log") + " SELECT post_id, labeled_at, target, polarity FROM labels_log WHERE labeler = 'first' AND version = 'v1' AND polarity <> 'neutral'")
def labeler_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiments parsed from the JSON that a labeler returns; unknown classes and broken JSON give none."""
    log = table(spark, sf_dir, "labels_log").where("labeler = 'first' AND version = 'v1'")
    shown = F.when(F.col("polarity") == "neutral", "unsure").otherwise(F.col("polarity"))
    raw = log.select("post_id", "labeled_at", F.to_json(F.struct(F.array(F.struct("target", shown.alias("polarity"))).alias("sentiments"))).alias("raw"))
    # broken text beside each message, which has to vanish
    raw = raw.unionAll(raw.select("post_id", "labeled_at", F.substring("raw", 1, 20)))
    parsed = raw.withColumn("m", F.from_json("raw", "sentiments array<struct<target: string, polarity: string>>"))
    rows = parsed.select("post_id", "labeled_at", F.inline("m.sentiments"))
    rows = rows.withColumn("target", F.nullif(F.trim("target"), F.lit("")))
    return rows.where(F.col("polarity").isin("positive", "negative", "neutral"))


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + """
SELECT post_id, 'title: ' || CASE WHEN trim(coalesce(title, '')) = '' THEN '(none)' ELSE trim(title) END || chr(10) || 'text: ' || CASE WHEN trim(coalesce(content, '')) = '' THEN '(none)' ELSE substr(trim(content), 1, 6) END
  || CASE WHEN length(trim(coalesce(content, ''))) > 6 THEN chr(10) || '(cut)' ELSE '' END AS prompt FROM posts""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an annotator is shown of a post; a text that is cut says so."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    or_none = lambda c: F.when(c == "", "(none)").otherwise(c)
    body = part("content")
    text = F.concat(
        F.lit("title: "), or_none(part("title")), F.lit("\ntext: "), or_none(F.substring(body, 1, 6)),
        F.when(F.length(body) > 6, "\n(cut)").otherwise(""),
    )
    return posts(spark, sf_dir).select("post_id", text.alias("prompt"))


_SLOTS = """SELECT 'slot' || CAST(user_id % 5 AS VARCHAR(9)) AS slot, CAST(event_id AS DOUBLE) AS at,
  CASE WHEN event_id % 61 = 0 THEN NULL ELSE event_id % 400 >= 60 END AS active, CASE WHEN event_id % 61 = 0 THEN NULL ELSE (event_id * 37) % 1000 END AS lag FROM {0}"""


@query(f"""WITH s AS ({_SLOTS.format('events')})
, r AS (SELECT *, sum(CASE WHEN active IS NULL OR active THEN 1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY "at") AS run FROM s)
, i AS (SELECT *, CASE WHEN NOT active THEN min(CASE WHEN NOT active THEN "at" END) OVER (PARTITION BY slot, run) END AS since FROM r)
, f AS (SELECT slot, "at", active IS NULL AS missing, coalesce("at" - since > 20, false) AS inactive, active IS NOT NULL AND lag > 990 AS lagging FROM i)
, u AS (UNPIVOT f ON missing, inactive, lagging INTO NAME alert VALUE raised)
SELECT slot, "at", alert, raised FROM (SELECT *, lag(raised, 1, false) OVER (PARTITION BY slot, alert ORDER BY "at") AS b FROM u) WHERE b <> raised""")
def slot_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication slots that are missing, inactive for long or lagging: when that begins and ends."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return watch.slot_alerts(spark.sql(_SLOTS.format("{e}"), e=events), 20, 990)


@query("""WITH s AS (SELECT event_type AS name, event_id::DOUBLE AS at, event_id % 200 >= 50 AS found FROM events)
, r AS (SELECT *, sum(found::INT) OVER (PARTITION BY name ORDER BY "at") AS run FROM s)
, i AS (SELECT *, CASE WHEN NOT found THEN min(CASE WHEN NOT found THEN "at" END) OVER (PARTITION BY name, run) END AS since FROM r)
, a AS (SELECT *, coalesce("at" - since > 30, false) AS alerting FROM i)
, b AS (SELECT *, lag(alerting, 1, false) OVER (PARTITION BY name ORDER BY "at") AS was FROM a)
SELECT name, "at", CASE WHEN since = "at" THEN 'missing' WHEN alerting AND NOT was THEN 'alert' ELSE 'recovered' END AS change FROM b WHERE since = "at" OR (alerting AND NOT was) OR (found AND was)""")
def missing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = events.select(F.col("event_type").alias("name"), F.col("event_id").cast("double").alias("at"), (F.col("event_id") % 200 >= 50).alias("found"))
    return watch.missing_alerts(seen, 30)


@query()
def connector_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restarts with doubling waits; each depends on the one before, so SQL can't express them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = F.col("event_id") % 100 < 60
    seen = events.select(F.col("event_type").alias("name"), F.col("event_id").cast("double").alias("at"), (~failed).alias("running"), failed.alias("failed"))
    return watch.restarts(seen, 2, 16)


@query(duckdb_ctes("comments_cdc") + " SELECT board, max(lsn) - min(lsn) AS span, count(*) FILTER (WHERE commented_at IS NULL) AS set_aside FROM comments_cdc GROUP BY board")
def dead_letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "comments_cdc").groupBy("board")
    return got.agg((F.max("lsn") - F.min("lsn")).alias("span"), F.count_if(F.col("commented_at").isNull()).alias("set_aside"))


@query("SELECT event_type, floor(120 / (avg(value) + 1.5::DOUBLE))::BIGINT AS per_worker, ceil(quantile_disc(value, 0.9) / greatest(1, floor(120 / (avg(value) + 1.5::DOUBLE))))::BIGINT AS workers FROM events GROUP BY event_type")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches that a worker does in two minutes, and workers that the ninetieth percentile of load needs."""
    got = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(
        F.floor(120 / (F.avg("value") + 1.5)).alias("per_worker"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90")
    )
    return got.select("event_type", "per_worker", F.ceil(F.col("p90") / F.greatest(F.lit(1), "per_worker")).alias("workers"))
