"""Latest-state tables and the dashboard's six panels."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.operators import latest
from tidewatch.plans.common import (
    BETWEEN_SQL, CHOSEN, CHOSEN_SQL, COMMENTS_SQL, MIN_SCORE, NOW_SQL, POSTS_SQL, SENTIMENT_SQL, VOTES_SQL,
    as_of, between, comments, moment, posts, query, sentiment, votes,
)
from tidewatch.sources.tables import SITE, duckdb_ctes, table

_ALL = duckdb_ctes("comments_cdc", "posts_cdc", "predictions") + COMMENTS_SQL + POSTS_SQL + VOTES_SQL + SENTIMENT_SQL
_TOP = 20


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + "SELECT * FROM posts")
def cdc_posts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir)


@query(duckdb_ctes("posts_cdc") + " SELECT post_id, board, title, push_count, boo_count, created_at, crawled_at, is_deleted, op, changed_at, lsn FROM posts_cdc")
def cdc_posts_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.posts_history(table(spark, sf_dir, "posts_cdc"))


@query(duckdb_ctes("comments_cdc") + COMMENTS_SQL + "SELECT * FROM comments")
def cdc_comments_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir)


@query(_ALL + "SELECT * FROM votes")
def post_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir)


@query(_ALL + "SELECT * FROM sentiment")
def post_sentiment_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment(spark, sf_dir)


@query(duckdb_ctes("labels_log") + " SELECT post_id, labeler, version, labeled_at, target, polarity FROM labels_log")
def labels_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label messages hold an array of target and polarity; each element becomes a row."""
    log = table(spark, sf_dir, "labels_log")
    messages = log.groupBy("post_id", "labeler", "version", "labeled_at").agg(
        F.collect_list(F.struct("target", "polarity")).alias("sentiments")
    )
    return messages.select("post_id", "labeler", "version", "labeled_at", F.inline("sentiments"))


@query(_ALL + f"""
SELECT time_bucket(INTERVAL '1 hour', commented_at, TIMESTAMP '1970-01-01') AS time, board, count(*) AS n FROM comments
WHERE NOT is_deleted AND commented_at {BETWEEN_SQL} AND board IN {CHOSEN_SQL} GROUP BY ALL""")
def panel_comment_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live comments by hour and board."""
    found = latest.live(comments(spark, sf_dir)).where(between("commented_at") & X.in_boards(F.col("board"), CHOSEN))
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("commented_at") / 3600) * 3600)
    return found.groupBy(hour.alias("time"), "board").agg(F.count("*").alias("n"))


@query(_ALL + f"""
SELECT p.board, count(*) FILTER (WHERE polarity = 'negative' AND score >= {MIN_SCORE}) AS negative,
  count(*) FILTER (WHERE polarity = 'neutral' AND score >= {MIN_SCORE}) AS neutral,
  count(*) FILTER (WHERE polarity = 'positive' AND score >= {MIN_SCORE}) AS positive,
  count(*) FILTER (WHERE score < {MIN_SCORE}) AS uncertain, count(*) FILTER (WHERE polarity IS NULL) AS none
FROM posts p LEFT JOIN sentiment s USING (post_id) WHERE p.created_at {BETWEEN_SQL} AND p.board IN {CHOSEN_SQL} GROUP BY p.board""")
def panel_sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by board and sentiment, unsure and missing predictions on their own."""
    chosen = posts(spark, sf_dir).where(between("created_at") & X.in_boards(F.col("board"), CHOSEN)).select("post_id", "board")
    wanted = sentiment_of(spark, sf_dir, chosen)
    bucket = X.sentiment_bucket(F.col("polarity"), F.col("score"), MIN_SCORE)
    names = ("negative", "neutral", "positive", "uncertain", "none")
    joined = chosen.join(wanted, "post_id", "left").withColumn("bucket", bucket)
    return joined.groupBy("board").agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in names])


def sentiment_of(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    """Newest predictions of the chosen posts; the others' rows are left out before they are grouped."""
    kept = table(spark, sf_dir, "predictions").join(chosen.select("post_id"), "post_id", "left_semi")
    return latest.sentiment_latest(kept)


@query(_ALL + f"""
SELECT date_trunc('day', p.created_at + INTERVAL '8 hours') - INTERVAL '8 hours' AS time,
  avg((polarity = 'negative')::INT) AS negative, avg((polarity = 'neutral')::INT) AS neutral, avg((polarity = 'positive')::INT) AS positive
FROM posts p JOIN sentiment s USING (post_id) WHERE p.created_at {BETWEEN_SQL} AND p.board IN {CHOSEN_SQL} GROUP BY 1""")
def panel_sentiment_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sentiments by local day of the posts that have a prediction."""
    chosen = posts(spark, sf_dir).where(between("created_at") & X.in_boards(F.col("board"), CHOSEN)).select("post_id", "created_at")
    joined = chosen.join(sentiment_of(spark, sf_dir, chosen), "post_id")
    part = lambda p: X.share(F.count_if(F.col("polarity") == p), F.count("*")).alias(p)
    return joined.groupBy(X.local_day(F.col("created_at")).alias("time")).agg(*map(part, ("negative", "neutral", "positive")))


def votes_of(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    kept = table(spark, sf_dir, "comments_cdc").join(chosen.select("post_id"), "post_id", "left_semi")
    return latest.post_votes(latest.comments_latest(kept)).drop("board")


@query(_ALL + f"""
SELECT p.post_id, p.board, coalesce(p.title, '') AS title, push, boo, boo / (push + boo)::DOUBLE AS share,
  CASE WHEN starts_with(url, '{SITE}') THEN url ELSE '' END AS url
FROM posts p JOIN votes v USING (post_id) WHERE p.created_at {BETWEEN_SQL} AND p.board IN {CHOSEN_SQL} AND push + boo >= 10
ORDER BY share DESC, p.post_id LIMIT {_TOP}""")
def panel_controversial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts with the greatest share of boos among at least ten votes."""
    chosen = posts(spark, sf_dir).where(between("created_at") & X.in_boards(F.col("board"), CHOSEN))
    joined = chosen.join(votes_of(spark, sf_dir, chosen), "post_id").where("push + boo >= 10")
    return joined.select(
        "post_id", "board", F.coalesce("title", F.lit("")).alias("title"), "push", "boo",
        X.share(F.col("boo"), F.col("push") + F.col("boo")).alias("share"), X.allowed_url(F.col("url"), SITE).alias("url"),
    ).orderBy(F.desc("share"), "post_id").limit(_TOP)


_HOT_SQL = f"""
, hot AS (SELECT post_id, board, count(*) AS new_comments FROM comments WHERE NOT is_deleted AND commented_at >= {NOW_SQL} - INTERVAL '24 hours'
  GROUP BY ALL ORDER BY new_comments DESC, post_id LIMIT {_TOP})
SELECT h.post_id, h.board, CASE WHEN p.post_id IS NULL THEN h.post_id ELSE coalesce(p.title, '') END AS title, new_comments,
  coalesce(push, 0) AS push, coalesce(boo, 0) AS boo, CASE WHEN push + boo >= 10 THEN boo / (push + boo)::DOUBLE END AS controversy,
  CASE WHEN polarity IS NULL THEN '' WHEN score < {MIN_SCORE} THEN 'uncertain' ELSE polarity END AS sentiment,
  CASE WHEN starts_with(url, '{SITE}') THEN url ELSE '' END AS url
FROM hot h LEFT JOIN posts p USING (post_id) LEFT JOIN votes v USING (post_id) LEFT JOIN sentiment s USING (post_id)"""


@query(_ALL + _HOT_SQL)
def panel_hot_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts with the most live comments in a day, with their titles, votes and sentiment.

    The limit makes the driving side twenty rows at most, so it is broadcast into the joins.
    """
    since = moment(as_of(spark, sf_dir), timedelta(hours=24))
    recent = latest.live(comments(spark, sf_dir)).where(F.col("commented_at") >= since)
    hot = recent.groupBy("post_id", "board").agg(F.count("*").alias("new_comments"))
    hot = F.broadcast(hot.orderBy(F.desc("new_comments"), "post_id").limit(_TOP))
    known = table(spark, sf_dir, "posts_cdc").join(hot.select("post_id"), "post_id", "left_semi")
    known = latest.posts_latest(known).select("post_id", "title", "url", F.lit(True).alias("known"))
    joined = hot.join(known, "post_id", "left").join(votes_of(spark, sf_dir, hot), "post_id", "left")
    joined = joined.join(sentiment_of(spark, sf_dir, hot), "post_id", "left")
    bucket = X.sentiment_bucket(F.col("polarity"), F.col("score"), MIN_SCORE)
    return joined.select(
        "post_id", "board", F.when(F.col("known"), F.coalesce("title", F.lit(""))).otherwise(F.col("post_id")).alias("title"),
        "new_comments", F.coalesce("push", F.lit(0)).alias("push"), F.coalesce("boo", F.lit(0)).alias("boo"),
        X.controversy(F.col("push"), F.col("boo")).alias("controversy"),
        F.when(bucket == "none", "").otherwise(bucket).alias("sentiment"),
        F.coalesce(X.allowed_url(F.col("url"), SITE), F.lit("")).alias("url"),
    )


@query(duckdb_ctes("alerts", "posts_cdc") + POSTS_SQL + f"""
SELECT a.created_at, alert_id, a.board, unit_type, CASE WHEN unit_type = 'post' THEN coalesce(nullif(p.title, ''), unit_key) ELSE unit_key END AS title,
  value, value / greatest(baseline, 1) AS ratio, zscore, CASE WHEN unit_type = 'post' AND starts_with(p.url, '{SITE}') THEN p.url ELSE '' END AS url
FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY created_at DESC) AS r FROM alerts WHERE created_at >= {NOW_SQL} - INTERVAL '7 days') a
LEFT JOIN posts p ON a.unit_key = p.post_id WHERE r = 1""")
def panel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent alerts, the newest row of each id, with the post's title and the multiple of the baseline."""
    since = moment(as_of(spark, sf_dir), timedelta(days=7))
    recent = latest.latest_by(table(spark, sf_dir, "alerts").where(F.col("created_at") >= since), ["alert_id"], ["created_at"])
    known = posts(spark, sf_dir).select(F.col("post_id").alias("unit_key"), F.col("title").alias("known"), "url")
    is_post = F.col("unit_type") == "post"
    joined = recent.join(known, "unit_key", "left")
    return joined.select(
        "created_at", "alert_id", "board", "unit_type",
        F.when(is_post, F.coalesce(F.nullif("known", F.lit("")), "unit_key")).otherwise(F.col("unit_key")).alias("title"),
        "value", (F.col("value") / F.greatest("baseline", F.lit(1.0))).alias("ratio"), "zscore",
        F.when(is_post, F.coalesce(X.allowed_url(F.col("url"), SITE), F.lit(""))).otherwise("").alias("url"),
    )
