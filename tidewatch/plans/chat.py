"""Queries behind the chat screens and the crawler's schedule."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.operators import latest
from tidewatch.plans.common import (
    BOARD, COMMENTS_SQL, NOW_SQL, POSTS_SQL, SENTIMENT_SQL, VOTES_SQL, as_of, comments, moment, posts, query, sentiment, votes,
)
from tidewatch.plans.panels import sentiment_of, votes_of
from tidewatch.sources.tables import duckdb_ctes, table

_ALL = duckdb_ctes("comments_cdc", "posts_cdc", "predictions", "alerts", "boards", "crawl_state") + COMMENTS_SQL + POSTS_SQL + VOTES_SQL + SENTIMENT_SQL
_DAY = timedelta(hours=24)
_WEEK = timedelta(days=29)
_SINCE = f"{NOW_SQL} - INTERVAL '29 days'"


@query(_ALL + """
SELECT p.post_id, p.board, p.title, coalesce(push, 0) AS push, coalesce(boo, 0) AS boo, coalesce(arrow, 0) AS arrow, polarity, score
FROM posts p LEFT JOIN votes v USING (post_id) LEFT JOIN sentiment s USING (post_id) WHERE p.board IN ('click', 'view')""")
def chat_post_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, votes and newest prediction of given posts; what is missing counts 0 or stays null."""
    chosen = posts(spark, sf_dir).where(F.col("board").isin("click", "view")).select("post_id", "board", "title")
    joined = chosen.join(votes_of(spark, sf_dir, chosen), "post_id", "left").join(
        sentiment_of(spark, sf_dir, chosen).drop("predicted_at"), "post_id", "left"
    )
    return joined.fillna(0, ["push", "boo", "arrow"])


_RECENT_SQL = f"""SELECT post_id, count(*) AS recent FROM comments WHERE NOT is_deleted AND commented_at >= {NOW_SQL} - INTERVAL '24 hours'"""


def recent_comments(spark: SparkSession, sf_dir: str, boards: list[str], window: timedelta, limit: int) -> DataFrame:
    """Posts by live comments in the window before now; an empty list stands for all boards."""
    found = latest.live(comments(spark, sf_dir)).where(F.col("commented_at") >= moment(as_of(spark, sf_dir), window))
    if boards:
        found = found.where(F.col("board").isin(boards))
    return found.groupBy("post_id").agg(F.count("*").alias("recent")).orderBy(F.desc("recent"), "post_id").limit(limit)


@query(_ALL + _RECENT_SQL + " GROUP BY post_id ORDER BY recent DESC, post_id LIMIT 5")
def chat_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_comments(spark, sf_dir, [], _DAY, 5)


@query(_ALL + _RECENT_SQL + " AND board IN ('click', 'error') GROUP BY post_id ORDER BY recent DESC, post_id LIMIT 5")
def chat_hot_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_comments(spark, sf_dir, ["click", "error"], _DAY, 5)


@query(_ALL + f"""
SELECT (SELECT count(*) FROM posts WHERE board = '{BOARD}' AND created_at >= {_SINCE}) AS posts,
  (SELECT count(*) FROM comments WHERE board = '{BOARD}' AND NOT is_deleted AND commented_at >= {_SINCE}) AS comments,
  (SELECT count(DISTINCT alert_id) FROM alerts WHERE board = '{BOARD}'
     AND created_at >= date_trunc('day', {NOW_SQL} + INTERVAL '8 hours') - INTERVAL '8 hours') AS alerts""")
def chat_overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and comments since a moment and alerts of the local day, in one row."""
    now = as_of(spark, sf_dir)
    since, today = moment(now, _WEEK), X.local_day(moment(now))
    kinds = [
        posts(spark, sf_dir).where((F.col("board") == BOARD) & (F.col("created_at") >= since)).select(F.lit("posts").alias("kind"), F.lit(None).cast("string").alias("id")),
        latest.live(comments(spark, sf_dir)).where((F.col("board") == BOARD) & (F.col("commented_at") >= since)).select(F.lit("comments"), F.lit(None).cast("string")),
        table(spark, sf_dir, "alerts").where((F.col("board") == BOARD) & (F.col("created_at") >= today)).select(F.lit("alerts"), "alert_id").distinct(),
    ]
    # one pass of counts over the three, in place of three results crossed
    every = kinds[0].unionAll(kinds[1]).unionAll(kinds[2])
    return every.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("posts", "comments", "alerts")])


@query(_ALL + f"""
SELECT polarity, count(*) AS n FROM sentiment WHERE post_id IN (SELECT post_id FROM posts WHERE board = '{BOARD}' AND created_at >= {_SINCE}) GROUP BY polarity""")
def chat_sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = posts(spark, sf_dir).where((F.col("board") == BOARD) & (F.col("created_at") >= moment(as_of(spark, sf_dir), _WEEK)))
    return sentiment_of(spark, sf_dir, chosen).groupBy("polarity").agg(F.count("*").alias("n"))


@query(_ALL + f"""
SELECT post_id, boo / (push + boo)::DOUBLE AS share FROM votes
WHERE push + boo >= 10 AND post_id IN (SELECT post_id FROM posts WHERE board = '{BOARD}' AND created_at >= {_SINCE})
ORDER BY share DESC, post_id LIMIT 3""")
def chat_controversial(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = posts(spark, sf_dir).where((F.col("board") == BOARD) & (F.col("created_at") >= moment(as_of(spark, sf_dir), _WEEK)))
    counted = votes_of(spark, sf_dir, chosen).where("push + boo >= 10")
    share = X.share(F.col("boo"), F.col("push") + F.col("boo")).alias("share")
    return counted.select("post_id", share).orderBy(F.desc("share"), "post_id").limit(3)


@query(_ALL + f"""
SELECT b.board, b.enabled, max(p.crawled_at) AS last_changed_at, count(p.post_id) FILTER (WHERE p.created_at >= {_SINCE}) AS recent_posts
FROM boards b LEFT JOIN posts p ON p.board = b.board GROUP BY b.board, b.enabled""")
def board_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board's last change and recent posts; boards without posts are listed too."""
    since = moment(as_of(spark, sf_dir), _WEEK)
    counted = posts(spark, sf_dir).groupBy("board").agg(
        F.max("crawled_at").alias("last_changed_at"), F.count_if(F.col("created_at") >= since).alias("recent_posts")
    )
    return table(spark, sf_dir, "boards").select("board", "enabled").join(counted, "board", "left").fillna(0, ["recent_posts"])


@query(_ALL + f"""
SELECT p.post_id, p.board, p.url, p.created_at, c.next_crawl_at FROM posts p JOIN boards b ON b.board = p.board LEFT JOIN crawl_state c ON c.post_id = p.post_id
WHERE b.enabled AND NOT p.is_deleted AND p.created_at > {NOW_SQL} - INTERVAL '29 days'
  AND (p.created_at > {NOW_SQL} - INTERVAL '5 days' OR p.comment_count >= b.recrawl_min_push)
  AND (c.next_crawl_at IS NULL OR c.next_crawl_at <= {NOW_SQL} - INTERVAL '10 days')
ORDER BY c.next_crawl_at ASC NULLS FIRST, p.created_at DESC, p.post_id LIMIT 500""")
def due_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts to crawl again: enabled board, young enough, busy enough unless very young, and due."""
    now = as_of(spark, sf_dir)
    joined = posts(spark, sf_dir).join(table(spark, sf_dir, "boards"), "board").join(table(spark, sf_dir, "crawl_state"), "post_id", "left")
    young = F.col("created_at") > moment(now, timedelta(days=5))
    due = joined.where(
        F.col("enabled") & ~F.col("is_deleted") & (F.col("created_at") > moment(now, timedelta(days=29)))
        & (young | (F.col("comment_count") >= F.col("recrawl_min_push")))
        & (F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= moment(now, timedelta(days=10))))
    )
    due = due.orderBy(F.asc_nulls_first("next_crawl_at"), F.desc("created_at"), "post_id").limit(500)
    return due.select("post_id", "board", "url", "created_at", "next_crawl_at")


@query(_ALL + f"""
SELECT post_id, CASE WHEN age < INTERVAL '1 hour' THEN now + INTERVAL '5 minutes' WHEN age < INTERVAL '6 hours' THEN now + INTERVAL '10 minutes'
  WHEN age < INTERVAL '24 hours' THEN now + INTERVAL '1 hour' ELSE now + INTERVAL '365 days' END AS next_crawl_at, now AS last_dispatched
FROM (SELECT post_id, {NOW_SQL} AS now, {NOW_SQL} - created_at AS age FROM posts)
UNION ALL SELECT post_id, next_crawl_at, NULL FROM crawl_state WHERE post_id NOT IN (SELECT post_id FROM posts)""")
def record_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule after dispatching all posts: the next time by age, a year ahead for old ones."""
    now = moment(as_of(spark, sf_dir))
    never = F.timestamp_micros(F.unix_micros(now) + F.lit(365 * 86_400_000_000))
    sent = posts(spark, sf_dir).select("post_id", F.coalesce(X.next_crawl(F.col("created_at"), now), never).alias("due"), now.alias("last_dispatched"))
    both = table(spark, sf_dir, "crawl_state").join(sent, "post_id", "full")
    return both.select("post_id", F.coalesce("due", "next_crawl_at").alias("next_crawl_at"), "last_dispatched")


@query(duckdb_ctes("subscriptions", "chat_settings", "muted_posts", "alerts") + """
, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY created_at DESC) AS r FROM alerts) WHERE r = 1)
SELECT a.alert_id, s.chat_id FROM a JOIN subscriptions s ON s.unit_type = 'board' AND s.unit_key = a.board LEFT JOIN chat_settings c ON c.chat_id = s.chat_id
WHERE CASE WHEN a.unit_type = 'post' THEN coalesce(post_alerts, true) ELSE coalesce(board_alerts, true) END
  AND NOT (a.unit_type = 'post' AND EXISTS (SELECT 1 FROM muted_posts m WHERE m.chat_id = s.chat_id AND m.post_id = a.unit_key)) AND s.chat_id <= 60""")
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets which alert: subscribers of its board, but for those that turned its kind off or muted the post.

    Chats up to 60 are on the allow-list here.
    """
    fresh = latest.latest_by(table(spark, sf_dir, "alerts"), ["alert_id"], ["created_at"])
    allowed = table(spark, sf_dir, "subscriptions").where("unit_type = 'board' AND chat_id <= 60")
    told = fresh.join(allowed.select("chat_id", F.col("unit_key").alias("board")), "board")
    told = told.join(table(spark, sf_dir, "chat_settings"), "chat_id", "left")
    wants = F.when(F.col("unit_type") == "post", F.col("post_alerts")).otherwise(F.col("board_alerts"))
    told = told.where(F.coalesce(wants, F.lit(True)))
    muted = table(spark, sf_dir, "muted_posts").select("chat_id", F.col("post_id").alias("unit_key"), F.lit("post").alias("unit_type"))
    return told.join(muted, ["chat_id", "unit_key", "unit_type"], "left_anti").select("alert_id", "chat_id")


@query(_ALL + f"""
SELECT board, least(make_timestamp(max(CAST(split_part(post_id, '.', 3) AS BIGINT)) * 1000000), TIMESTAMP '2024-01-01 20:00:00') - INTERVAL '10 minutes' AS since
FROM posts GROUP BY board""")
def latest_post_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By board the newest time in a post's name, no later than now, less a margin."""
    newest = F.timestamp_seconds(F.max(F.split_part("post_id", F.lit("."), F.lit(3)).cast("bigint")))
    now = F.lit("2024-01-01 20:00:00").cast("timestamp")
    return posts(spark, sf_dir).groupBy("board").agg((F.least(newest, now) - F.expr("INTERVAL 10 MINUTES")).alias("since"))


@query(_ALL + f"""
SELECT (SELECT max(changed_at) FROM comments_cdc) AS comments_at, (SELECT max(changed_at) FROM posts_cdc) AS posts_at,
  (SELECT max(changed_at) FROM comments_cdc WHERE board = 'nowhere') AS nothing_at""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each stream last changed; null for an empty one."""
    c = table(spark, sf_dir, "comments_cdc").select(F.lit("c").alias("of"), "changed_at", "board")
    p = table(spark, sf_dir, "posts_cdc").select(F.lit("p"), "changed_at", "board")
    newest = lambda kind: F.max(F.when(kind, F.col("changed_at")))
    return c.unionAll(p).agg(
        newest(F.col("of") == "c").alias("comments_at"), newest(F.col("of") == "p").alias("posts_at"),
        newest((F.col("of") == "c") & (F.col("board") == "nowhere")).alias("nothing_at"),
    )


@query(duckdb_ctes("boards") + " SELECT board, (row_number() OVER (ORDER BY board) - 1) % 3 AS partition FROM boards WHERE enabled")
def board_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled boards dealt in name order to three partitions."""
    # boards are configuration: the window sorts as many rows as there are boards
    from pyspark.sql import Window

    enabled = table(spark, sf_dir, "boards").where("enabled")
    return enabled.select("board", ((F.row_number().over(Window.orderBy("board")) - 1) % 3).cast("long").alias("partition"))
