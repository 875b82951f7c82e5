"""Versioned rows: the newest row of each key, and histories of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The whole row with the greatest version of each key.

    One aggregation with map-side combine takes all columns from one row; ``version`` has to
    order the rows of a key totally.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def comments_latest(cdc: DataFrame) -> DataFrame:
    """Newest comment rows with a tombstone flag; deleted rows stay until the newest row is known."""
    marked = cdc.withColumn("is_deleted", F.coalesce("deleted", F.lit("false")) == "true").drop("deleted", "op")
    return latest_by(marked, ["post_id", "floor"], ["lsn"])


def live(latest: DataFrame) -> DataFrame:
    return latest.where(~F.col("is_deleted"))


def posts_latest(cdc: DataFrame) -> DataFrame:
    """Newest post rows. Deleted posts stay, as their comments do."""
    return latest_by(cdc.drop("op", "changed_at", "version"), ["post_id"], ["lsn"])


def posts_history(cdc: DataFrame) -> DataFrame:
    """Every change of a post, with defaults for what a change row may lack."""
    return cdc.select(
        "post_id", "board", "title", "push_count", "boo_count", "created_at", "crawled_at", "is_deleted",
        F.coalesce("op", F.lit("")).alias("op"),
        F.coalesce("changed_at", F.timestamp_millis(F.lit(0))).alias("changed_at"),
        F.coalesce("lsn", F.lit(0)).alias("lsn"),
    )


def post_votes(comments: DataFrame) -> DataFrame:
    """Pushes, boos and arrows of each post over its live comments."""
    return live(comments).groupBy("post_id", "board").agg(
        F.count_if(F.col("type") == "push").alias("push"),
        F.count_if(F.col("type") == "boo").alias("boo"),
        F.count_if(F.col("type") == "arrow").alias("arrow"),
    )


def sentiment_latest(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each post: polarity and the largest of the three scores."""
    scored = predictions.withColumn("score", F.greatest("positive", "negative", "neutral"))
    newest = F.max_by(F.struct("polarity", "score", "predicted_at"), F.struct("predicted_at", "model_version"))
    return scored.groupBy("post_id").agg(newest.alias("s")).select("post_id", "s.*")
