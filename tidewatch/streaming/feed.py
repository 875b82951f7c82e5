"""A durable change feed: changes have numbers without gaps and the rows before and after them.

A batch's changes are numbered on from those of the batches before it, in the order of their
keys. Its first number and its count are kept beside it, so that a batch that runs again gets the
numbers that it had.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ChangeFeed:
    """Changes in a folder a batch; ``schema`` is theirs, the number left out."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path.rstrip("/"), keys

    def _fs(self, spark: SparkSession):
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def ranges(self, spark: SparkSession) -> dict[int, tuple[int, int]]:
        """By batch its first number and how many it has."""
        fs, path = self._fs(spark)
        found = fs.globStatus(path(f"{self.path}/_ranges/*.json")) or []
        names = [s.getPath().toString() for s in found]
        if not names:
            return {}
        rows = spark.read.schema("batch int, first long, count long").json(names).collect()  # a row for each batch
        return {r.batch: (r["first"], r["count"]) for r in rows}

    def write(self, changes: DataFrame, number: int) -> tuple[int, int]:
        """Number a batch's changes and keep them; the first number, and how many there are.

        Keys are dealt by ranges, the rows of each range counted, and the counts added up, so that no
        task sees all changes. Batches count in the order of their numbers, and a batch is numbered
        on from the newest one before it.
        """
        spark = changes.sparkSession
        before = [(k, v) for k, v in self.ranges(spark).items() if k < number]
        first = sum(max(before)[1]) if before else 0
        draft = f"{self.path}/_draft/{number:010d}"
        # ranges come from samples, so the range of each row is written before rows are counted
        dealt = changes.repartitionByRange(*self.keys).withColumn("__range", F.spark_partition_id())
        dealt.write.mode("overwrite").parquet(draft)
        kept = spark.read.schema(dealt.schema).parquet(draft)
        counts = sorted((r["__range"], r["count"]) for r in kept.groupBy("__range").count().collect())
        at, starts = first, []
        for k, n in counts:
            starts.append((k, at))
            at += n
        place = F.row_number().over(Window.partitionBy("__range").orderBy(*self.keys))
        begins = spark.createDataFrame(starts, "__range int, __first long")
        told = kept.join(F.broadcast(begins), "__range")  # a row for each range
        told = told.select((F.col("__first") + place - 1).alias("change"), *changes.columns)
        told.write.mode("overwrite").parquet(f"{self.path}/{number:010d}")
        fs, path = self._fs(spark)
        out = fs.create(path(f"{self.path}/_ranges/{number:010d}.json"), True)
        out.write(bytearray(json.dumps({"batch": number, "first": first, "count": at - first}).encode()))
        out.close()
        fs.delete(path(draft), True)
        return first, at - first

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """All changes with the batch that made them, in no order; ``change`` numbers them from 0 on."""
        reader = spark.read.schema(schema) if schema else spark.read
        found = [f"{self.path}/{k:010d}" for k in sorted(self.ranges(spark))]
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{10})/[^/]*$", 1).cast("int")
        return reader.parquet(*found).withColumn("batch", batch)


def images(merged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The changes of a merge whose rows have ``action`` and ``before``: keys, op, and both images.

    An insert has no image before and a delete none after. A row that is marked deleted stays in its
    table, so that is an update of it.
    """
    op = F.when(F.col("action") == "insert", "c").when(F.col("action") == "remove", "d").otherwise("u")
    after = F.when(F.col("action") != "remove", F.struct(*columns))
    return merged.where("action <> 'keep'").select(*keys, op.alias("op"), "before", after.alias("after"))
