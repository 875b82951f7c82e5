"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many sources at most, and sums of theirs, 8 bytes each, are broadcast; more are joined with salts.
SOURCES_BROADCAST = 10_000
SUMS_BROADCAST = 4_000_000
SALTS = 32


def source_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    source_col: str = "source",
    power: float = 0.5,
    total: float | None = None,
) -> DataFrame:
    """Mean repetitions of a document by source: ``(source, n, rate)``.

    ``weights(source, weight)`` gives the target shares, which need not sum to 1; a source
    that it lacks gets 0. Without it a source of n documents weighs n ** ``power``.
    ``total`` is the number of rows aimed at, the number of documents if not given.
    A null source is a source like any other.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("__w")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(w, F.col("source").eqNullSafe(F.col("__w")), "left").drop("__w")
        counts = counts.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    rows, mass = counts.agg(F.sum("n"), F.sum("weight")).first()
    if not rows or not mass:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    goal = float(rows if total is None else total)
    return counts.select("source", "n", (F.lit(goal) * F.col("weight") / F.lit(float(mass)) / F.col("n")).alias("rate"))


def poisson_least(rate: Column) -> Column:
    """The first k whose cumulative value isn't nil."""
    return F.greatest(F.ceil(rate - F.sqrt(rate) * 12 - 20), F.lit(0)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from ``poisson_least`` on as an array that reaches to where the tail is nil.

    Terms are ratios to the one at the mode, made outwards from it, so that a large rate doesn't underflow.
    """
    least, mode = poisson_least(rate), F.floor(rate).cast("int")
    top = F.ceil(rate + F.sqrt(rate) * 12 + 20).cast("int")
    above = F.aggregate(
        F.sequence(mode + 1, top),
        F.array(F.lit(1.0)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * rate / k)),
    )
    terms = F.aggregate(
        F.when(mode > least, F.reverse(F.sequence(least + 1, mode))).otherwise(F.array().cast("array<int>")),
        above,
        lambda acc, k: F.concat(F.array(F.element_at(acc, 1) * k / rate), acc),
    )
    return F.aggregate(
        terms,
        F.array().cast("array<double>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + p)),
        lambda acc: F.transform(acc, lambda c: c / F.element_at(acc, -1)),
    )


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) made of the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    power: float = 0.5,
    total: float | None = None,
) -> DataFrame:
    """Repeat each document so that the sources meet their target weights, in random order.

    A document's count inverts the Poisson distribution with its source's mean at a uniform
    number hashed from seed and id; a count of 0 leaves it out. The copies are dealt to
    partitions by a hash and sorted by it in each, which is a global shuffle. The result has
    the columns of ``docs``, ``copy`` (from 1) and ``shuffle_key``.

    A document's count is one more than the number of Poisson sums up to its number, however large
    the rate. Rows of the same id draw the same count; a null id draws by the row's text instead;
    null, empty and very long texts are rows like any other; an empty table gives an empty result;
    columns of ``docs`` named copy or shuffle_key are replaced, all others stay whatever their names.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, weights, source_col=source_col, power=power, total=total)
    rates = rates.select("source", poisson_least(F.col("rate")).alias("least"), poisson_cdf(F.col("rate")).alias("cdf"))
    text = F.col(text_col).cast("string") if text_col in docs.columns else F.lit("")
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    packed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("from"), F.concat(F.lit(f"{seed}:"), own).alias("key"))
    same = F.col("from").eqNullSafe(F.col("source"))
    bounds = rates.agg(F.count("*"), F.sum(F.size("cdf"))).first()
    if bounds[0] <= SOURCES_BROADCAST and (bounds[1] or 0) <= SUMS_BROADCAST:
        dealt = packed.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = packed.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        dealt = dealt.join(salted, same & (F.col("own") == F.col("salt")))
    count = F.col("least") + F.size(F.filter("cdf", lambda c: c <= hash_uniform(F.col("key"))))
    dealt = dealt.withColumn("n", count).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    dealt = dealt.withColumn("shuffle_key", F.md5(F.concat("key", F.lit(":"), F.col("copy").cast("string"))))
    return dealt.select("row.*", "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
