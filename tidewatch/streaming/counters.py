"""Counters of sliding windows by event time, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding_counters(rows: DataFrame, by: list[str], *, at: str = "changed_at", width: str = "10 minutes", step: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """(by, start, end, n): rows of each window of ``width`` that starts at a multiple of ``step``.

    Over a stream a window is done, and its state dropped, once the newest row is ``delay`` past its
    end; in append mode it is given then, in update mode whenever it changes. Rows that come later
    are left out and counted by the query's progress, see ``left_out``. A batch has no late rows.
    """
    counted = rows.withWatermark(at, delay).groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def left_out(query: StreamingQuery) -> int:
    """How many counts came too late so far, each a task's rows of one window and key."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
