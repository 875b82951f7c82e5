"""Counts over time: sliding windows, gap-free grids, exponential baselines, gaps and bursts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket_counts(df: DataFrame, by: Sequence[str], at: Column, seconds: int) -> DataFrame:
    """Rows by key and numbered time bucket."""
    number = F.floor(F.unix_seconds(at) / seconds).cast("long")
    return df.groupBy(*by, number.alias("bucket")).agg(F.count("*").alias("n"))


def sliding(counts: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Add the sum over the ``width`` buckets that end with each row's."""
    w = Window.partitionBy(*by).orderBy("bucket").rangeBetween(-(width - 1), 0)
    return counts.withColumn("total", F.sum("n").over(w))


def grid(counts: DataFrame, by: Sequence[str], longest: int) -> DataFrame:
    """Rows for buckets without any, up to ``longest`` before each bucket that has some."""
    before = F.lag("bucket").over(Window.partitionBy(*by).orderBy("bucket"))
    known = counts.withColumn("before", before)
    start = F.when(F.col("before").isNull(), F.col("bucket")).otherwise(F.greatest(F.col("before") + 1, F.col("bucket") - longest))
    filled = known.withColumn("at", F.explode(F.sequence(start, F.col("bucket"))))
    return filled.select(*by, F.when(F.col("at") == F.col("bucket"), F.col("n")).otherwise(0).alias("n"), F.col("at").alias("bucket"))


def ewma(series: DataFrame, by: Sequence[str], value: str, alpha: float, least_std: float) -> DataFrame:
    """Mean and variance after each bucket and the z-score by what was known before it.

    The first value sets the mean. A key's series, one number a bucket, is folded in order as it
    comes in Arrow batches; a task keeps two numbers of it, and keys run in parallel.
    """
    keys = list(by)
    ordered = series.select(*keys, "bucket", F.col(value).cast("double").alias("x")).repartition(*keys).sortWithinPartitions(*keys, "bucket")

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, s = None, 0.0, 0.0
        for b in it:
            means, variances, scores = [], [], []
            for *now, x in zip(*(b.column(c).to_pylist() for c in (*keys, "x"))):
                if now != key:
                    key, m, s, now_z = now, x, x * x, None
                else:
                    now_z = (x - m) / max(math.sqrt(max(s - m * m, 0.0)), least_std)
                    m, s = m * (1 - alpha) + x * alpha, s * (1 - alpha) + x * x * alpha
                means.append(m)
                variances.append(max(s - m * m, 0.0))
                scores.append(now_z)
            cols = [pa.array(v, pa.float64()) for v in (means, variances, scores)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "mean", "var", "z"])

    kinds = [*ordered.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("mean", "var", "z"))]
    return ordered.mapInArrow(fold, T.StructType(kinds))


def bursts(df: DataFrame, by: Sequence[str], at: str, count: int, seconds: int) -> DataFrame:
    """Keys with ``count`` rows in less than so many seconds."""
    w = Window.partitionBy(*by).orderBy(at)
    later = F.lead(F.unix_micros(at), count - 1).over(w) - F.unix_micros(at)
    return df.withColumn("__d", later).where(F.col("__d") < seconds * 1_000_000).select(*by).distinct()


def replay_delays(df: DataFrame, by: Sequence[str], at: str, order: str, speed: float) -> DataFrame:
    """Add the wait before each row: how far it is ahead of all before it, 0 at the start and when behind."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.unix_micros(at) - F.max(F.unix_micros(at)).over(w)
    return df.withColumn("delay_s", F.coalesce(F.greatest(ahead, F.lit(0)), F.lit(0)) / (1_000_000 * speed))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "occurrence") -> DataFrame:
    """Number the rows of equal keys from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def transitions(df: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    """Rows at which a state differs from the row before; the first counts if it is true."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__b", F.coalesce(before, F.lit(False))).where(F.col("__b") != F.col(state)).drop("__b")
