"""Agreement, classification and order statistics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which ties and tables list the classes.
CLASSES = ("positive", "negative", "neutral")


def confusion(pairs: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of every pair of classes, zeros included: (*by, truth, guess, n)."""
    made = [F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"), F.count_if((F.col(truth) == t) & (F.col(guess) == g)).alias("n")) for t in CLASSES for g in CLASSES]
    return pairs.groupBy(*by).agg(F.array(*made).alias("cells")).select(*by, F.inline("cells"))


def agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and Cohen's kappa in one aggregation; kappa is 0 for no rows and 1 if chance alone agrees.

    Chance is summed in whole numbers, so that equal counts give equal results on any plan.
    """
    rows = [F.count_if(F.col(a) == c) for c in CLASSES]
    cols = [F.count_if(F.col(b) == c) for c in CLASSES]
    chance = sum((r * c for r, c in zip(rows, cols)), F.lit(0))
    got = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), chance.alias("chance"))
    n, same, by_chance = F.col("n"), F.col("same"), F.col("chance")
    kappa = F.when(n == 0, 0.0).when(n * n == by_chance, 1.0).otherwise((n * same - by_chance) / (n * n - by_chance))
    return got.select(*by, "n", F.when(n == 0, 0.0).otherwise(same / n).alias("accuracy"), kappa.alias("kappa"))


def f1_scores(pairs: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 of each class and their mean; a class without rows on either side scores 0."""
    scores = []
    for c in CLASSES:
        hit = F.count_if((F.col(truth) == c) & (F.col(guess) == c))
        total = F.count_if(F.col(truth) == c) + F.count_if(F.col(guess) == c)
        scores.append(F.when(total == 0, 0.0).otherwise(2 * hit / total).alias(f"f1_{c}"))
    got = pairs.groupBy(*by).agg(*scores)
    mean = sum((F.col(f"f1_{c}") for c in CLASSES), F.lit(0.0)) / len(CLASSES)
    return got.withColumn("macro_f1", mean)


def interpolated(column: str, q: float) -> Column:
    """Percentile by linear interpolation; 0 for no values."""
    return F.coalesce(F.percentile(column, q), F.lit(0.0))


def nearest_rank(column: str, q: float) -> Column:
    """The ceil(q n)-th smallest value."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def upper_median(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """The (n div 2 + 1)-th smallest value of each group, by rank rather than by gathering a group."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(column))).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*by, F.col(column).alias("upper_median"))


def average_rank(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Add the rank of a value in its group, ties sharing the mean of theirs.

    Counts of distinct values are ranked, not rows, so that the window holds one row a value.
    """
    counts = df.groupBy(*by, column).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(column)
    ranks = counts.withColumn(name, F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0).drop("__n")
    return df.join(ranks, [*by, column])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation by group; null for fewer than three rows or without variance."""
    ranked = average_rank(average_rank(df, x, by, "__rx"), y, by, "__ry")
    got = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.covar_pop("__rx", "__ry").alias("both"), F.var_pop("__rx").alias("vx"), F.var_pop("__ry").alias("vy")
    )
    fine = (F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return got.select(*by, "n", F.when(fine, F.col("both") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def confidence_buckets(df: DataFrame, score: str, right: str, thresholds: Sequence[float]) -> DataFrame:
    """By threshold the share of scores below it, and rows and accuracy at or above it where ``right`` is known."""
    made = []
    for t in thresholds:
        known = (F.col(score) >= t) & F.col(right).isNotNull()
        n = F.count_if(known)
        made.append(
            F.struct(
                F.lit(t).alias("threshold"), F.coalesce(F.try_divide(F.count_if(F.col(score) < t), F.count("*")), F.lit(0.0)).alias("below"), n.alias("n"),
                F.when(n > 0, F.count_if(known & F.col(right)) / n).alias("accuracy"),
            )
        )
    return df.agg(F.array(*made).alias("rows")).select(F.inline("rows"))
