"""Reports as sections, each a small frame: how two models compare, how one does against labels, what votes say."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.sources.files import markdown

#: A report's sections by title: a frame, and those of its columns that say what a row is about.
Sections = Mapping[str, tuple[DataFrame, Sequence[str]]]
ALL = "all"


def _scoped(whole: DataFrame, by_board: DataFrame) -> DataFrame:
    return whole.withColumn("board", F.lit(ALL)).unionByName(by_board)


def comparison(pairs: DataFrame, latency: DataFrame, thresholds: Sequence[float] = (0.4, 0.5, 0.6, 0.7)) -> Sections:
    """Two models side by side, from ``pairs(board, polarity_a, score_a, polarity_b, score_b, label)`` and ``latency(model, latency_s)``.

    Agreement and confusion for all posts and by board, seconds to a prediction, how sure each model
    is and how right then, and both against the labels.
    """
    a, b = "polarity_a", "polarity_b"
    labelled = pairs.where("label IS NOT NULL")
    each = lambda of: reduce(DataFrame.unionByName, [of(m).withColumn("model", F.lit(m)) for m in ("a", "b")])
    sure = lambda m: stats.confidence_buckets(pairs.withColumn("right", F.col("label") == F.col(f"polarity_{m}")), f"score_{m}", "right", thresholds)
    seconds = latency.groupBy("model").agg(
        F.count("*").alias("n"), stats.interpolated("latency_s", 0.5).alias("p50"), stats.interpolated("latency_s", 0.95).alias("p95"), F.max("latency_s").alias("max")
    )
    return {
        "agreement": (_scoped(stats.agreement(pairs, a, b), stats.agreement(pairs, a, b, ["board"])), ["board"]),
        "confusion": (_scoped(stats.confusion(pairs, a, b), stats.confusion(pairs, a, b, ["board"])), ["board", "truth", "guess"]),
        "latency": (seconds, ["model"]),
        "confidence": (each(sure), ["model", "threshold"]),
        "labels": (each(lambda m: stats.agreement(labelled, "label", f"polarity_{m}")), ["model"]),
        "f1": (each(lambda m: stats.f1_scores(labelled, "label", f"polarity_{m}")), ["model"]),
    }


def evaluation(pairs: DataFrame, guess: str, annotators: DataFrame, small: int = 30) -> Sections:
    """One model against the labels of ``pairs(board, label, guess)``, and ``annotators(first, second)`` against each other.

    Boards with fewer than ``small`` labelled posts are marked, as their scores say little.
    """
    labelled = pairs.where("label IS NOT NULL")
    posts = _scoped(labelled.agg(F.count("*").alias("n")), labelled.groupBy("board").agg(F.count("*").alias("n")))
    few = (F.col("n") < small) & (F.col("board") != ALL)
    return {
        "posts": (posts.withColumn("few", few.cast("int")), ["board"]),
        "f1": (_scoped(stats.f1_scores(labelled, "label", guess), stats.f1_scores(labelled, "label", guess, ["board"])), ["board"]),
        "confusion": (stats.confusion(labelled, "label", guess), ["truth", "guess"]),
        "annotators": (stats.agreement(annotators, "first", "second"), []),
    }


def push_ratio(ratios: DataFrame) -> Sections:
    """Votes against classes, from ``ratios(board, polarity, level, ratio)``: quartiles by class, rank correlation by board."""
    quarters = ratios.groupBy("polarity").agg(F.count("*").alias("n"), F.percentile("ratio", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    return {
        "quartiles": (quarters.select("polarity", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))]), ["polarity"]),
        "correlation": (stats.spearman(ratios, "ratio", "level", ["board"]), ["board"]),
    }


def stacked(report: Sections) -> DataFrame:
    """(section, scope, measure, value): every number of a report as a row, so that reports of any shape fit one table."""
    parts = []
    for section, (df, scope) in report.items():
        cells = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in scope]
        about = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope]) if scope else F.lit(ALL)
        parts.append(df.select(F.lit(section).alias("section"), about.alias("scope"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def text(title: str, report: Sections) -> str:
    """A report in Markdown, a table a section, rows in order of what they are about."""
    tables = []
    for section, (df, scope) in report.items():
        columns = [*scope, *(c for c in df.columns if c not in scope)]
        tables.append(markdown(section, df.orderBy(*scope) if scope else df, columns))
    return "\n".join([f"# {title}\n", *tables])
