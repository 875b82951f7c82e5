"""What becomes of fetches that fail: retries by timers, giving up, and streaks of failures.

Events are (url, site, kind, outcome, seq): kind "list" or "post", outcome "ok", "transient" or
"failed", in order of seq within a url.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "url string, decision string, tries int, seq long"


@dataclass(frozen=True)
class FetchRules:
    """Limits (fixed values) and waits."""

    # a post found by a list is given up after so many polls of the list have failed to get it
    polls: int = 3
    # a fetch that fails for the moment is tried so often
    attempts: int = 5
    # so many failures in a row mean that the site can't be reached
    streak: int = 20
    first_wait_ms: int = 1_000
    longest_wait_ms: int = 60_000

    def wait_ms(self, tries: int) -> int:
        return min(self.first_wait_ms << (tries - 1), self.longest_wait_ms)


class FetchProcessor(StatefulProcessor):
    """Decisions by url: "retry" when the time has come, "next_poll", "give_up" or "done"."""

    def __init__(self, rules: FetchRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "attempts int, polls int, seq long, due_ms long")

    def _settle(self, decision: str, tries: int, seq: int, key: str) -> tuple:
        if self.state.exists():
            due = self.state.get()[3]
            if due is not None:
                self.handle.deleteTimer(due)
            self.state.clear()
        return key, decision, tries, seq

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        events = sorted((r for b in rows for r in b[["seq", "kind", "outcome"]].itertuples(index=False)), key=lambda r: r.seq)
        for seq, kind, outcome in events:
            attempts, polls, _, due = self.state.get() if self.state.exists() else (0, 0, 0, None)
            if outcome == "ok":
                out.append(self._settle("done", attempts + polls + 1, seq, key[0]))
            elif outcome == "transient":
                attempts += 1
                if attempts >= self.rules.attempts:
                    out.append(self._settle("give_up", attempts, seq, key[0]))
                    continue
                if due is not None:
                    self.handle.deleteTimer(due)
                due = now + self.rules.wait_ms(attempts)
                self.handle.registerTimer(due)
                self.state.update((attempts, polls, int(seq), due))
            elif kind == "list":
                polls += 1
                if polls >= self.rules.polls:
                    out.append(self._settle("give_up", polls, seq, key[0]))
                else:
                    self.state.update((attempts, polls, int(seq), due))
                    out.append((key[0], "next_poll", polls, seq))
            else:
                out.append(self._settle("give_up", attempts + 1, seq, key[0]))
        yield pd.DataFrame(out, columns=["url", "decision", "tries", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            attempts, polls, seq, due = self.state.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((attempts, polls, seq, None))
                out.append((key[0], "retry", attempts, seq))
        yield pd.DataFrame(out, columns=["url", "decision", "tries", "seq"])

    def close(self) -> None:
        pass


def decisions(events: DataFrame, rules: FetchRules = FetchRules()) -> DataFrame:  # noqa: B008
    """Decisions of a stream of fetch events. Needs the RocksDB state store, and a trigger by time, as timers have no last batch."""
    return events.groupBy("url").transformWithStateInPandas(
        statefulProcessor=FetchProcessor(rules), outputStructType=DECISIONS, outputMode="Append", timeMode="ProcessingTime"
    )


class StreakProcessor(StatefulProcessor):
    """By site "unreachable" when a streak of failures has its full length, and "recovered" at the success that ends it."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "failures long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures = self.state.get()[0] if self.state.exists() else 0
        out = []
        for seq, failed in sorted((r for b in rows for r in b[["seq", "failed"]].itertuples(index=False)), key=lambda r: r[0]):
            if failed:
                failures += 1
                if failures == self.most:
                    out.append((key[0], seq, "unreachable", failures))
            else:
                if failures >= self.most:
                    out.append((key[0], seq, "recovered", failures))
                failures = 0
        self.state.update((failures,))
        yield pd.DataFrame(out, columns=["site", "seq", "change", "failures"])

    def close(self) -> None:
        pass


STREAKS = "site string, seq long, change string, failures long"


def streak_stream(fetches: DataFrame, most: int) -> DataFrame:
    """Changes of ``fetches(site, seq, failed)``, a stream."""
    return fetches.groupBy("site").transformWithStateInPandas(statefulProcessor=StreakProcessor(most), outputStructType=STREAKS, outputMode="Append", timeMode="None")


#: Numbers of a stretch of fetches that is looked at by itself.
STRETCH = 1 << 17


def streaks(fetches: DataFrame, most: int) -> DataFrame:
    """The same changes of a batch, found by stretches of seq, so that no window holds a whole site.

    The last success before a fetch is that of its stretch or of an earlier one, and the number of
    fetches up to it is counted the same way, so that a streak's length is a difference.
    """
    rows = fetches.select("site", "seq", "failed").withColumn("s", F.floor(F.col("seq") / STRETCH))
    each = rows.groupBy("site", "s").agg(F.count("*").alias("n"), F.count_if(~F.col("failed")).alias("good"))
    before = Window.partitionBy("site").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    add = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    each = each.select("site", "s", add("n").alias("n0"), add("good").alias("good0"))
    within = Window.partitionBy("site", "s").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.join(each, ["site", "s"]).withColumn("place", F.col("n0") + F.count("*").over(within))
    # a streak is what has the same number of successes before it; its successes end it
    streak = F.col("good0") + F.count_if(~F.col("failed")).over(within) - (~F.col("failed")).cast("int")
    told = told.withColumn("streak", streak)
    first = told.groupBy(F.col("site").alias("of"), F.col("streak").alias("k")).agg(F.min("place").alias("first"))
    told = told.join(first, F.col("site").eqNullSafe(F.col("of")) & (F.col("streak") == F.col("k")))
    before_it: Column = F.col("place") - F.col("first")  # failures of the streak before this fetch
    change = F.when(F.col("failed") & (before_it == most - 1), "unreachable").when(~F.col("failed") & (before_it >= most), "recovered")
    failures = F.when(F.col("failed"), before_it + 1).otherwise(before_it)
    return told.select("site", "seq", change.alias("change"), failures.alias("failures")).where("change IS NOT NULL")
