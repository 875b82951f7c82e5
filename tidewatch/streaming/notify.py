"""Alerts fanned out to those who want them, each once, over retries and restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.streaming.consumer import Transient
from tidewatch.streaming.jobs import BucketTable

KEYS = ["alert_id", "chat_id"]
SENT = "alert_id string, chat_id long, outcome string"
#: What a send comes to. One to be repeated fails its batch, which is tried again; a chat that
#: forbids messages is forgotten; a refused message is not sent again.
OUTCOMES = ("sent", "forbidden", "refused", "again")


def messages(alerts: DataFrame, wanted: Callable[[DataFrame], DataFrame], within: str = "1 hour") -> DataFrame:
    """(alert_id, chat_id) of a stream of alerts joined with static tables, repeated alerts left out.

    An alert is known to be a repetition for so long after its ``created_at``; later ones are left to
    the sender's log, and alerts older than that when they come are left out, as their surge is
    over. ``wanted`` joins alerts with who wants them and keeps ``created_at``.
    """
    told = wanted(alerts.withWatermark("created_at", within)).select(*KEYS, "created_at")
    return told.dropDuplicatesWithinWatermark(KEYS)


class Sender:
    """For ``foreachBatch``: sends what the log doesn't have, from inside tasks, and logs every outcome.

    ``send(rows, attempt)`` takes a list of messages and gives an outcome for each. Outcomes of every
    attempt are written before it is decided whether the batch has to be tried again, so that a
    batch that was sent in part goes on with the rest. Only messages of a task that is lost while it
    sends may go out twice. ``forget`` gets the chats that forbid messages.
    """

    def __init__(self, log: BucketTable, attempts: str, send: Callable[[list[dict], int], list[str]], forget: Callable[[DataFrame], None] | None = None):
        self.log, self.attempts, self.send, self.forget = log, attempts, send, forget

    def _tried(self, spark, number: int) -> tuple[int, DataFrame]:
        """How many attempts a batch has had, and their outcomes that aren't to be repeated."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.attempts}/{number:010d}/*")
        found = [s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []]
        rows = spark.read.schema(SENT).parquet(*found) if found else spark.createDataFrame([], SENT)
        return len(found), rows.where("outcome <> 'again'")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, send = batch.sparkSession, self.send
        rows = batch.select(*KEYS).dropDuplicates(KEYS).persist()
        try:
            before = self.log.before(rows, number).select(*KEYS)
            attempt, tried = self._tried(spark, number)
            due = rows.join(before, KEYS, "left_anti").join(tried.select(*KEYS), KEYS, "left_anti")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    told = send(b.to_pylist(), attempt) if b.num_rows else []
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], [*KEYS, "outcome"])

            path = f"{self.attempts}/{number:010d}/{attempt:04d}"
            due.mapInArrow(run, SENT).write.parquet(path)
            late = spark.read.schema(SENT).parquet(path).where("outcome = 'again'").count()
            if late:
                raise Transient(f"{late} messages of batch {number} weren't sent")
            done = self._tried(spark, number)[1]
            if self.forget:
                self.forget(done.where("outcome = 'forbidden'").select("chat_id").distinct())
            self.log.change(rows, number, lambda old: old.unionByName(done))
        finally:
            rows.unpersist()


def retried(sender: Callable[[DataFrame, int], None], tries: int, sleep: Callable[[float], None]) -> Callable[[DataFrame, int], None]:
    """A sender that tries a batch again in place, waiting twice as long each time."""

    def run(batch: DataFrame, number: int) -> None:
        for attempt in range(tries):
            try:
                return sender(batch, number)
            except Transient as e:
                if attempt + 1 == tries:
                    raise
                sleep(2.0**attempt if e.retry_after_s is None else e.retry_after_s)

    return run


def recipients(alerts: DataFrame, subscriptions: DataFrame, settings: DataFrame, muted: DataFrame) -> DataFrame:
    """Alerts joined with the chats that subscribe to their board, want their kind and didn't mute the post.

    All sides but the alerts are static, so that a stream of alerts may be joined.
    """
    told = alerts.join(subscriptions.where("unit_type = 'board'").select("chat_id", F.col("unit_key").alias("board")), "board")
    told = told.join(settings.select("chat_id", "post_alerts", "board_alerts"), "chat_id", "left")
    wants = F.when(F.col("unit_type") == "post", F.col("post_alerts")).otherwise(F.col("board_alerts"))
    told = told.where(F.coalesce(wants, F.lit(True)))
    quiet = muted.select("chat_id", F.col("post_id").alias("unit_key"), F.lit("post").alias("unit_type"))
    return told.join(quiet, ["chat_id", "unit_key", "unit_type"], "left_anti")
