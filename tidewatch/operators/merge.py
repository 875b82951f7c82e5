"""Conditional merges of page snapshots into tables of posts and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A live snapshot writes a post only if one of these differs.
CHANGING = ("title", "content", "push_count", "boo_count", "comment_count")


def newest_snapshots(snapshots: DataFrame, order: str = "crawled_at") -> DataFrame:
    """One snapshot a post: the newest, and of equally new ones the one that is live."""
    rest = [c for c in snapshots.columns if c != "post_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), ~F.col("is_deleted")))
    return snapshots.groupBy("post_id").agg(best.alias("s")).select("post_id", "s.*")


def merge_posts(posts: DataFrame, snapshots: DataFrame, before: str | None = None) -> DataFrame:
    """All posts after the merge, with ``action``: insert, update, delete or keep, and on wish the row ``before`` as a struct.

    A snapshot counts if it is newer than what it meets. A live one updates if a changing column
    differs or the post was deleted, and brings it back; author, board, url and creation time stay. A
    deleted one sets the flag and the time only, and is ignored for unknown posts. Both sides
    are matched in one full outer join on the key.
    """
    s = snapshots.select("post_id", *[F.col(c).alias(f"s_{c}") for c in snapshots.columns if c != "post_id"])
    both = posts.withColumn("p", F.lit(True)).join(s.withColumn("s", F.lit(True)), "post_id", "full")
    newer = F.col("s") & F.col("p") & (F.col("crawled_at") < F.col("s_crawled_at"))
    differs = F.lit(False)
    for c in CHANGING:
        differs |= ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    action = (
        F.when(F.col("p").isNull(), F.when(F.col("s_is_deleted"), F.lit(None)).otherwise(F.lit("insert")))
        .when(newer & ~F.col("s_is_deleted") & (F.col("is_deleted") | differs), F.lit("update"))
        .when(newer & F.col("s_is_deleted") & ~F.col("is_deleted"), F.lit("delete"))
        .otherwise(F.lit("keep"))
    )
    both = both.withColumn("action", action).where(F.col("action").isNotNull())
    written, fresh = F.col("action").isin("insert", "update"), F.col("action") == "insert"
    columns = []
    for c in posts.columns:
        if c == "post_id":
            columns.append(F.col(c))
        elif c == "is_deleted":
            columns.append(F.when(written, F.lit(False)).when(F.col("action") == "delete", F.lit(True)).otherwise(F.col(c)).alias(c))
        elif c == "crawled_at":
            columns.append(F.when(F.col("action") == "keep", F.col(c)).otherwise(F.col("s_crawled_at")).alias(c))
        else:
            taken = written if c in CHANGING else fresh
            columns.append(F.when(taken, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c))
    image = [F.when(F.col("p"), F.struct(*posts.columns)).alias(before)] if before else []
    return both.select(*columns, "action", *image)


def sync_targets(merged: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The live snapshots that aren't older than their posts after the merge."""
    now = merged.select("post_id", F.col("crawled_at").alias("now"))
    return snapshots.where(~F.col("is_deleted")).join(now, "post_id").where(F.col("now") <= F.col("crawled_at")).drop("now")


def sync_comments(comments: DataFrame, targets: DataFrame, fresh: DataFrame) -> DataFrame:
    """All comments after the merge with ``action``: insert, update, delete or keep.

    ``targets(post_id, max_floor)`` are the snapshots that count and ``fresh`` their comments.
    Floors beyond the last one go, equal comments stay as they are, posts without a snapshot too.
    """
    keys, own = ["post_id", "floor"], ("type", "author", "content", "commented_at")
    seen = fresh.join(targets.select("post_id"), "post_id", "left_semi").select(
        *keys, *[F.col(c).alias(f"s_{c}") for c in own], F.lit(True).alias("s")
    )
    both = comments.withColumn("c", F.lit(True)).join(seen, keys, "full")
    both = both.join(targets.select("post_id", F.col("max_floor").alias("last")), "post_id", "left")
    differs = F.lit(False)
    for c in own:
        differs |= ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    action = (
        F.when(F.col("c").isNull(), F.lit("insert"))
        .when(F.col("last").isNotNull() & (F.col("floor") > F.col("last")), F.lit("delete"))
        .when(F.col("s") & differs, F.lit("update"))
        .otherwise(F.lit("keep"))
    )
    both = both.withColumn("action", action)
    new = F.col("action").isin("insert", "update")
    return both.select(*keys, *[F.when(new, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in own], "action")


def change_rows(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows (op c, u or d) of a merge; rows that it kept make none."""
    op = F.when(F.col("action") == "insert", "c").when(F.col("action") == "delete", "d").otherwise("u")
    return merged.where("action <> 'keep'").select(*keys, op.alias("op"))
