"""Structured Streaming jobs: change rows into tables, merges of snapshots, alerts, dead letters.

Sources are any streaming frames with the change rows' columns; Kafka with Avro or JSON on a
cluster, files in tests. Each job is a transformation for ``writeStream`` or a function for
``foreachBatch`` that can be run again for the same batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import base64
from tidewatch.operators import heat, inference, latest, merge
from tidewatch.streaming.feed import ChangeFeed, images

POST_ID = r"^[A-Za-z0-9_-]+\.M\.[0-9]+\.A\.[0-9A-F]{3}$"


def broken_rule() -> Column:
    """The first rule that a comment row breaks, null if none."""
    return (
        F.when(~F.col("post_id").rlike(POST_ID), "post_id")
        .when(F.col("floor") < 1, "floor")
        .when(~F.col("type").isin("push", "boo", "arrow"), "type")
        .when(F.col("commented_at").isNull(), "time")
        .when(~F.col("op").isin("c", "u", "d", "r"), "op")
    )


def split_dead_letters(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the rule and the row as base64 JSON."""
    marked = rows.withColumn("rule", rule)
    payload = base64(F.to_json(F.struct(*rows.columns)).cast("binary"))
    return marked.where("rule IS NULL").drop("rule"), marked.where("rule IS NOT NULL").select("rule", payload.alias("payload_b64"))


def parse_json(raw: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed messages, and those that aren't JSON objects. Unknown fields are skipped, missing ones null."""
    parsed = raw.withColumn("__m", F.from_json(F.col(column).cast("string"), schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("__m").isNull() | F.col("__m._corrupt").isNotNull()
    good = parsed.where(~bad).select("__m.*").drop("_corrupt")
    return good, parsed.where(bad).select(F.lit("json").alias("rule"), base64(F.col(column).cast("binary")).alias("payload_b64"))


class BucketTable:
    """A keyed table in hash buckets, of which a batch rewrites those only that its keys fall into.

    A batch writes a folder of its own number with the buckets that it touches, an empty one where no
    row is left; a bucket's newest folder holds it. Running a batch again reads what lay before it
    and writes the same.
    """

    def __init__(self, path: str, keys: list[str], empty: DataFrame, buckets: int = 256):
        self.path, self.keys, self.empty, self.buckets = path, keys, empty, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, spark) -> dict[int, dict[int, str]]:
        """By bucket the paths of its folders by batch number."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/bucket=*")
        out: dict[int, dict[int, str]] = {}
        for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []:
            at = s.getPath()
            out.setdefault(int(at.getName()[7:]), {})[int(at.getParent().getName())] = at.toString()
        return out

    def read(self, spark, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows as they are, or as they were before a batch, of some buckets or all."""
        found = []
        for k, by in self._folders(spark).items():
            numbers = [n for n in by if before is None or n < before]
            if numbers and (only is None or k in only):
                found.append(by[max(numbers)])
        return spark.read.schema(self.empty.schema).parquet(*found) if found else self.empty

    def touched(self, batch: DataFrame) -> set[int]:
        """The buckets that a batch's keys fall into, of which there are no more than buckets."""
        return {r[0] for r in batch.select(self.bucket()).distinct().collect()}

    def before(self, batch: DataFrame, number: int) -> DataFrame:
        """The buckets that a batch's keys fall into, as they were before it."""
        return self.read(batch.sparkSession, number, self.touched(batch))

    def change(self, batch: DataFrame, number: int, make: Callable[[DataFrame], DataFrame]) -> None:
        """Write what ``make`` gives for the rows of the buckets that the batch's keys fall into."""
        spark, touched = batch.sparkSession, self.touched(batch)
        made = make(self.read(spark, number, touched)).select(*self.empty.columns).withColumn("bucket", self.bucket())
        folder = f"{self.path}/{number:010d}"
        made.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        for k in touched - {k for k, by in self._folders(spark).items() if number in by}:
            # without a folder of its own the bucket's rows of an earlier batch would come back
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={k}/_empty")
            mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()

    def vacuum(self, spark, keep: int = 2) -> int:
        """Delete the folders of a bucket but the newest ``keep``, which a batch that runs again may need."""
        gone = 0
        for by in self._folders(spark).values():
            for n in sorted(by)[:-keep]:
                where = spark._jvm.org.apache.hadoop.fs.Path(by[n])
                gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        return gone


def merge_latest(table: BucketTable, version: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep the newest row of each key."""

    def run(batch: DataFrame, number: int) -> None:
        table.change(batch, number, lambda old: latest.latest_by(old.unionByName(batch), table.keys, version))

    return run


def merge_snapshots(table: BucketTable, changes: ChangeFeed) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge page snapshots into posts, and add what changes to a feed, before the posts are written.

    A batch that runs again meets the posts as they were before it, so that its changes, their
    numbers and their images are the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        columns = table.empty.columns

        def make(old: DataFrame) -> DataFrame:
            merged = merge.merge_posts(old, merge.newest_snapshots(batch).select(*columns), before="before")
            changes.write(images(merged, table.keys, columns), number)
            return merged

        table.change(batch, number, make)

    return run


def append_once(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: add the rows whose keys the table lacks, such as alerts by their ids."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(table.keys).persist()
        table.change(rows, number, lambda old: old.unionByName(rows.join(old.select(*table.keys), table.keys, "left_anti")))
        rows.unpersist()

    return run


def infer_posts(known: BucketTable, classify: Callable[[Column], Column], publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: classify the posts whose text is new, publish, then note the texts of all posts seen.

    ``known`` has (post_id, text_hash). A batch that fails before its end notes nothing, so that it
    publishes the same when it runs again; ``publish`` gets its number to tell.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # it is looked at three times
        told = inference.to_infer(batch, known.before(batch, number))
        publish(told.where("infer").select("post_id", "text_hash", classify(F.col("text")).alias("scores")), number)
        seen = told.select("post_id", "text_hash")
        known.change(batch, number, lambda old: old.join(seen, "post_id", "left_anti").unionByName(seen))
        batch.unpersist()

    return run


def alert_stream(comments: DataFrame, config: heat.SurgeRules, live: bool = False) -> DataFrame:
    """Alerts of a comment stream, of what is new by the clock if it is live. Ids repeat on a replay, so that a sink can drop what it has."""
    return heat.alerts(heat.stream(comments, config, live), config)


def surge(start: str, board: str, posts: int, per_minute: int, minutes: int, spark) -> DataFrame:
    """Made-up new comments: so many a minute on so many posts, with one comment after the end to close it."""
    n = per_minute * minutes
    rows = spark.range(n + 1).withColumn("minute", F.when(F.col("id") == n, minutes + 1).otherwise(F.floor(F.col("id") / per_minute)))
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("minute") * 60_000_000)
    post = F.format_string(board + ".M.%d.A.%03X", F.lit(1_700_000_000) + F.col("id") % posts, F.col("id") % posts)
    return rows.select(
        post.alias("post_id"), F.lit(board).alias("board"), (F.col("id") + 1).cast("int").alias("floor"), F.lit("push").alias("type"),
        F.lit("s").alias("author"), F.lit("surge").alias("content"), at.alias("commented_at"), F.lit("c").alias("op"),
        F.lit("false").alias("deleted"), F.col("id").alias("lsn"), at.alias("changed_at"),
    )
