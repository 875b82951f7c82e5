"""Samples that come out the same on every run and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys that only the seed changes."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def stratified(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    return first_per_group(df, group, [hash_order(F.col(key), seed), key], n)


def in_percent(key: Column, percent: int) -> Column:
    """Is the key in a stable sample of so many percent."""
    return F.crc32(key.cast("string").cast("binary")) % 100 < percent


def split_share(df: DataFrame, group: Sequence[str], key: str, share: float, seed: int) -> DataFrame:
    """Add ``validation``: the first ceil(n share) rows of each group in hash order."""
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("validation", rank <= F.ceil(F.count("*").over(w) * F.lit(share)))
