"""Watchdogs over observations: alerts when a state changes, and restarts that wait longer each time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lasting(df: DataFrame, by: str, at: str, bad: Column) -> DataFrame:
    """Add ``since``, when the unbroken run of bad observations up to each row began; null on good rows."""
    w = Window.partitionBy(by).orderBy(at)
    run = F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__run", run).withColumn("__bad", bad)
    start = F.min(F.when(F.col("__bad"), F.col(at))).over(Window.partitionBy(by, "__run"))
    return marked.withColumn("since", F.when(F.col("__bad"), start)).drop("__run", "__bad")


def slot_alerts(slots: DataFrame, inactive_s: float, lag_bytes: int) -> DataFrame:
    """Alerts raised and cleared for ``slots(slot, at, active, lag)``; a missing slot has a null ``active``.

    Raised are missing, inactive for longer than allowed, and lagging.
    """
    seen = lasting(slots, "slot", "at", F.coalesce(~F.col("active"), F.lit(False)))
    states = {
        "missing": F.col("active").isNull(),
        "inactive": F.coalesce(F.col("at") - F.col("since") > inactive_s, F.lit(False)),
        "lagging": F.col("active").isNotNull() & F.coalesce(F.col("lag") > lag_bytes, F.lit(False)),
    }
    w = Window.partitionBy("slot").orderBy("at")
    seen = seen.withColumns(states)
    changes = [
        F.struct(F.lit(k).alias("alert"), F.col(k).alias("raised"), F.coalesce(F.lag(k).over(w), F.lit(False)).alias("before"))
        for k in states
    ]
    changed = seen.withColumn("__c", F.array(*changes)).select("slot", "at", F.inline("__c"))
    return changed.where("raised <> before").drop("before")


def missing_alerts(seen: DataFrame, alert_s: float) -> DataFrame:
    """Changes for ``seen(name, at, found)``: missing at once, alert when it lasts, recovered after an alert."""
    told = lasting(seen, "name", "at", ~F.col("found"))
    w = Window.partitionBy("name").orderBy("at")
    told = told.withColumn("alerting", F.coalesce(F.col("at") - F.col("since") > alert_s, F.lit(False)))
    told = told.withColumn("was", F.coalesce(F.lag("alerting").over(w), F.lit(False)))
    change = (
        F.when(F.col("since") == F.col("at"), "missing")
        .when(F.col("alerting") & ~F.col("was"), "alert")
        .when(F.col("found") & F.col("was"), "recovered")
    )
    return told.select("name", "at", change.alias("change")).where("change IS NOT NULL")


def restarts(seen: DataFrame, first_s: float, most_s: float) -> DataFrame:
    """When to restart the failed of ``seen(name, at, running, failed)``, and changes of their state.

    The first failure restarts at once; while it lasts the next restart comes no sooner than a
    wait that doubles up to a limit. Running in all parts ends it. What happens depends on the
    restart before, so each name's observations are folded in order.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_restarts(rows.sort_values("at"), first_s, most_s), columns=["name", "at", "restart", "change", "restarts"])

    return seen.groupBy("name").applyInPandas(fold, "name string, at double, restart boolean, change string, restarts int")


def _restarts(rows: pd.DataFrame, first_s: float, most_s: float) -> Iterator[tuple]:
    due, wait, count = None, first_s, 0
    for r in rows[["name", "at", "running", "failed"]].itertuples(index=False):
        if r.failed and (due is None or r.at >= due):
            wait = first_s if due is None else min(2 * wait, most_s)
            change, due, count = ("failed" if due is None else None), r.at + wait, count + 1
            yield r.name, r.at, True, change, count
        elif r.running and due is not None:
            yield r.name, r.at, False, "recovered", count
            due, count = None, 0
