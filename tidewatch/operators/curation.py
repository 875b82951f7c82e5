"""Checks of labels and examples before they are used, and the choice of a model by its figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def import_errors(lines: DataFrame, allowed: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``lines(batch, line, post_id, polarity)`` with ``error``: "class", "unknown" (not a post of the batch), "twice" or null.

    ``allowed(batch, post_id)``. The first line of a post counts, whatever is wrong with later ones.
    A class that isn't one makes the line invalid, so it doesn't count as a post's line.
    """
    valid = F.coalesce(F.col("polarity").isin(*classes), F.lit(False))
    told = lines.join(allowed.select("batch", "post_id").distinct().withColumn("__there", F.lit(True)), ["batch", "post_id"], "left")
    first = F.min(F.when(valid & F.col("__there"), F.col("line"))).over(Window.partitionBy("batch", "post_id"))
    error = F.when(~valid, "class").when(F.col("__there").isNull(), "unknown").when(F.col("line") > first, "twice")
    return told.withColumn("error", error).drop("__there")


def import_whole(checked: DataFrame) -> DataFrame:
    """The lines of batches without any error; a batch with one is refused whole."""
    refused = checked.where("error IS NOT NULL").select("batch").distinct()
    return checked.join(refused, "batch", "left_anti").drop("error")


def quota_shortfalls(rows: DataFrame, by: str, quotas: Mapping[str, int]) -> DataFrame:
    """(by, wanted, found) of the quotas that the rows can't fill."""
    wanted = rows.sparkSession.createDataFrame(list(quotas.items()), f"{by} string, wanted long")
    found = rows.where(F.col(by).isin(*quotas)).groupBy(by).agg(F.count("*").alias("found"))
    joined = wanted.join(found, by, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where("found < wanted")


def fill_quotas(rows: DataFrame, by: str, quotas: Mapping[str, int], order: Sequence[Column | str]) -> DataFrame:
    """So many rows of each group as its quota says; an error if there are fewer."""
    short = quota_shortfalls(rows, by, quotas).orderBy(by).collect()  # as many as quotas at most
    if short:
        raise ValueError("; ".join(f"{r[0]}: {r.found} of {r.wanted}" for r in short))
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    some = rows.where(F.col(by).isin(*quotas)).withColumn("__r", rank).where(F.col("__r") <= max(quotas.values()))
    return some.where(F.col("__r") <= quota[F.col(by)]).drop("__r")


def example_faults(examples: DataFrame, classes: Sequence[str], least: int = 10) -> DataFrame:
    """(fault, n): blank texts, unknown classes, and classes with fewer than ``least`` rows, as counts above 0."""
    blank = F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "")
    unknown = F.count_if(~F.coalesce(F.col("polarity").isin(*classes), F.lit(False)))
    counts = [F.count_if(F.col("polarity") == c) for c in classes]
    small = [F.struct(F.lit(f"few {c}").alias("fault"), F.when(n < least, F.lit(least) - n).otherwise(0).alias("n")) for c, n in zip(classes, counts)]
    made = F.array(F.struct(F.lit("blank").alias("fault"), blank.alias("n")), F.struct(F.lit("unknown").alias("fault"), unknown.alias("n")), *small)
    return examples.agg(made.alias("__all")).select(F.inline("__all")).where("n > 0")


def checked_examples(examples: DataFrame, classes: Sequence[str], least: int = 10) -> DataFrame:
    """The examples, or an error that names their faults."""
    faults = example_faults(examples, classes, least).collect()  # two and one a class at most
    if faults:
        raise ValueError("; ".join(f"{r.fault}: {r.n}" for r in faults))
    return examples


def pick_kinds(figures: DataFrame, most_lost: float = 0.02) -> DataFrame:
    """By model the figures of the small kind if it loses little F1 and is faster, else of the exact one.

    ``figures(model, kind, f1, p50, slowest, memory_mb)`` with kinds "exact" and "small".
    """
    row = F.struct("kind", "f1", "p50", "slowest", "memory_mb")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, row))
    both = figures.groupBy("model").agg(of("exact").alias("e"), of("small").alias("s"))
    small = (F.col("e.f1") - F.col("s.f1") <= most_lost) & (F.col("s.p50") < F.col("e.p50"))
    return both.select("model", F.when(F.col("e").isNull() | small, F.col("s")).otherwise(F.col("e")).alias("r")).select("model", "r.*")


def choose_model(picked: DataFrame, preferred: str, gap: float = 0.01, p50: float = 30, slowest: float = 60, memory_mb: float = 1200) -> DataFrame:
    """The model with the higher F1, the preferred one if the gap is small; ``passes`` says if it is fast and small enough.

    One row a model comes in, so one task orders them.
    """
    best = F.max("f1").over(Window.partitionBy())
    near = picked.withColumn("__near", best - F.col("f1") < gap)
    first = near.orderBy((F.col("__near") & (F.col("model") == preferred)).desc(), F.col("f1").desc(), "model").limit(1)
    passes = (F.col("p50") < p50) & (F.col("slowest") <= slowest) & (F.col("memory_mb") <= memory_mb)
    return first.drop("__near").withColumn("passes", passes)


def runtime_stats(batches: DataFrame, by: str) -> DataFrame:
    """By group over ``batches(batch, seconds, posts)``: seconds a batch and milliseconds a post; the first batch warms up.

    A batch's posts each take its seconds shared out, so percentiles of posts weigh batches by their posts.
    """
    first = batches.groupBy(by).agg(F.min("batch").alias("__first"))
    timed = batches.join(first, by).where(F.col("batch") > F.col("__first"))
    timed = timed.withColumn("ms", F.col("seconds") / F.col("posts") * 1000)
    nearest = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY seconds)")
    stats = timed.groupBy(by).agg(F.count("*").alias("batches"), F.sum("posts").alias("posts"), nearest(0.5).alias("batch_p50_s"), F.max("seconds").alias("batch_max_s"))
    # posts that take as long are counted together, then running counts find the percentile's value
    alike = timed.groupBy(by, "ms").agg(F.sum("posts").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(by).orderBy("ms"))
    ranked = alike.withColumn("__upto", upto).join(stats.select(by, "posts"), by)
    at = lambda q: F.min(F.when(F.col("__upto") >= F.ceil(F.col("posts") * F.lit(q)), F.col("ms")))
    return stats.join(ranked.groupBy(by).agg(at(0.5).alias("post_p50_ms"), at(0.95).alias("post_p95_ms")), by)


def backfill_tasks(posts: DataFrame, since: Column, a_page: int = 20, pages_a_task: int = 3, pages_at_most: int = 80) -> DataFrame:
    """(board, task, first_page, last_page, oldest, goes_on) of reading listings back to a moment.

    Newest posts come first. Reading ends with the page whose oldest post isn't newer than ``since``, or
    with the last one; a chain of tasks has ``pages_at_most``. ``goes_on`` is false in a chain's last task
    that came to its end, null in one that the limit ended. Spark keeps only a chain's posts by board.
    """
    w = Window.partitionBy("board").orderBy(F.desc("created_at"), "post_id")
    # one post more than a chain reads tells whether there would have been another page
    seen = posts.select("board", "post_id", "created_at").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= a_page * pages_at_most + 1)
    paged = seen.groupBy("board", F.ceil(F.col("__r") / a_page).alias("page")).agg(F.min("created_at").alias("oldest"))
    boards = Window.partitionBy("board")
    told = paged.select(
        "*", F.min(F.when(F.col("oldest") <= since, F.col("page"))).over(boards).alias("__end"), F.max("page").over(boards).alias("__pages")
    )
    end = F.coalesce("__end", "__pages")
    read = told.where((F.col("page") <= end) & (F.col("page") <= pages_at_most))
    tasks = read.groupBy("board", F.ceil(F.col("page") / pages_a_task).alias("task"), end.alias("__end")).agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("oldest").alias("oldest")
    )
    goes_on = F.when(F.col("last_page") == F.col("__end"), False).when(F.col("last_page") < pages_at_most, True)
    return tasks.select("board", "task", "first_page", "last_page", "oldest", goes_on.alias("goes_on"))


def rows_as_json(spark: SparkSession, sql: str, args: Mapping[str, object], **tables: DataFrame) -> DataFrame:
    """One JSON object a row of a query with named, typed parameters."""
    got = spark.sql(sql, args=dict(args), **tables)
    return got.select(F.to_json(F.struct(*got.columns), {"ignoreNullFields": "false"}).alias("line"))
