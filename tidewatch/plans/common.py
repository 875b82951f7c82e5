"""What the query modules share: registration and the frames that most of them start from."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import latest
from tidewatch.sources.tables import driver_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The range and boards that the panel queries are given; both ends of the range count.
RANGE = "2024-01-04 00:00:00", "2024-01-26 12:00:00"
CHOSEN = "%7Bclick%2Cview%2Cerror%7D"
CHOSEN_SQL = "('click', 'view', 'error')"
MIN_SCORE = 0.45
BOARD = "click"


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def at(text: str) -> Column:
    """A UTC moment as a literal."""
    return F.lit(text).cast("timestamp")


def between(column: str) -> Column:
    return F.col(column).between(at(RANGE[0]), at(RANGE[1]))


BETWEEN_SQL = f"BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The time that stands for now: when the last event was seen."""
    us = driver_table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us or 0)


def moment(at: datetime, minus: timedelta = timedelta(0)) -> Column:
    us = (at - minus - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(us))


NOW_SQL = "(SELECT max(ts) FROM events)"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest comment rows, tombstones included."""
    return latest.comments_latest(table(spark, sf_dir, "comments_cdc"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.posts_latest(table(spark, sf_dir, "posts_cdc"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.post_votes(comments(spark, sf_dir))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.sentiment_latest(table(spark, sf_dir, "predictions"))


#: Common table expressions of the frames above, to follow duckdb_ctes().
COMMENTS_SQL = """, comments AS (
  SELECT * EXCLUDE (deleted, op, r), coalesce(deleted, 'false') = 'true' AS is_deleted
  FROM (SELECT *, row_number() OVER (PARTITION BY post_id, floor ORDER BY lsn DESC) AS r FROM comments_cdc) WHERE r = 1)
"""
POSTS_SQL = """, posts AS (
  SELECT * EXCLUDE (op, changed_at, version, r)
  FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY lsn DESC) AS r FROM posts_cdc) WHERE r = 1)
"""
VOTES_SQL = """, votes AS (
  SELECT post_id, board, count(*) FILTER (WHERE type = 'push') AS push, count(*) FILTER (WHERE type = 'boo') AS boo,
    count(*) FILTER (WHERE type = 'arrow') AS arrow FROM comments WHERE NOT is_deleted GROUP BY post_id, board)
"""
SENTIMENT_SQL = """, sentiment AS (
  SELECT post_id, polarity, greatest(positive, negative, neutral) AS score, predicted_at FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY predicted_at DESC, model_version DESC) AS r FROM predictions) WHERE r = 1)
"""
