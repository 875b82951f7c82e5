"""A running consumer: messages are decoded, held against rules, handled, and the bad ones kept as dead letters.

Each micro-batch is one unit: it is handled and its dead letters are written before its offsets
count as done, and a batch that is run again does the same again. So a handler has to be one that
may be repeated under the batch's number, as those of ``streaming.jobs`` are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources import topics

DEAD = "topic string, partition int, offset long, error string, key_b64 string, payload_b64 string"
_ROW_ERRORS = "topic string, partition int, offset long, error string"


class Transient(Exception):
    """A handler's failure that another try may mend: the batch is tried again as a whole, after so many seconds if they are told."""

    def __init__(self, message: str, retry_after_s: float | None = None):
        super().__init__(message)
        self.retry_after_s = retry_after_s


class DataError(Exception):
    """What a sink raises if it can't take some of the rows that it was given."""


@dataclass
class Consumer:
    """``handle(rows, number)`` gets the good rows of a batch, with their messages' coordinates.

    It may return rejections: coordinates and an error, which become dead letters too. ``rule`` is
    the first rule that a row breaks, over the fields of ``row``, or null. Dead letters of a batch
    are a folder of its number below ``dead``.
    """

    schema: str
    handle: Callable[[DataFrame, int], DataFrame | None]
    dead: str
    rule: Column | None = None
    decode: Callable[[DataFrame, str], DataFrame] = topics.decode_json
    tries: int = 6
    sleep: Callable[[float], None] = time.sleep
    waits: list[float] = field(default_factory=list)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        batch = batch.persist()  # a batch is read once, though it is looked at several times
        try:
            told = self.decode(batch, self.schema)
            if self.rule is not None:
                told = told.withColumn("error", F.coalesce("error", self.rule))
            good = told.where("error IS NULL").select(*topics.COORDINATES, "row.*")
            rejected = self._handled(good, number)
            bad = topics.dead_letters(told)
            if rejected is not None:
                # rejections are few, and the batch is looked up once more for what they held
                late = batch.join(rejected.select(*topics.COORDINATES, "error"), list(topics.COORDINATES))
                bad = bad.unionByName(topics.dead_letters(late))
            bad.write.mode("overwrite").parquet(f"{self.dead}/{number:010d}")
        finally:
            batch.unpersist()

    def _handled(self, good: DataFrame, number: int) -> DataFrame | None:
        for attempt in range(self.tries):
            try:
                return self.handle(good, number)
            except Transient as e:
                if attempt + 1 == self.tries:
                    raise
                wait = min(2.0**attempt, 60.0) if e.retry_after_s is None else e.retry_after_s
                self.waits.append(wait)
                self.sleep(wait)
        raise AssertionError("a batch is tried once at least")

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        trigger = trigger or {"processingTime": "0 seconds"}
        return messages.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_dead_letters(spark, path: str) -> DataFrame:
    """All dead letters; an empty frame if no batch has run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], DEAD)
    return spark.read.schema(DEAD).option("recursiveFileLookup", "true").parquet(path)


def write_or_reject(rows: DataFrame, write: Callable[[pa.RecordBatch], None]) -> DataFrame:
    """Write all rows that the sink takes, from inside tasks; the result has the rows that it doesn't and why.

    A group of rows that fails with ``DataError`` is halved until single rows are left, so that
    each bad row costs as many more writes as its group can be halved, and all others are
    written. ``write`` must be atomic for a group and may be given a row again when a task is
    repeated. Rows have their messages' coordinates; the result is evaluated lazily, and the
    writes happen when it is.
    """
    columns = rows.columns

    def attempt(group: pa.RecordBatch) -> Iterator[tuple]:
        try:
            write(group)
        except DataError as e:
            if group.num_rows == 1:
                yield (*(group.column(columns.index(c))[0].as_py() for c in topics.COORDINATES), str(e))
                return
            half = group.num_rows // 2
            yield from attempt(group.slice(0, half))
            yield from attempt(group.slice(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string()]
        for b in batches:
            bad = list(attempt(b)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*bad) if bad else [()] * 4, kinds)], [*topics.COORDINATES, "error"])

    return rows.mapInArrow(run, _ROW_ERRORS)


def rejecting(write: Callable[[int], Callable[[pa.RecordBatch], None]], scratch: str) -> Callable[[DataFrame, int], DataFrame]:
    """A handler that writes rows from inside tasks and returns those rejected.

    ``write(number)`` makes the function that writes a group of rows of that batch. Rejections are
    kept in a folder of the batch's number, so that rows are written once however often they
    are read.
    """

    def handle(rows: DataFrame, number: int) -> DataFrame:
        path = f"{scratch}/{number:010d}"
        write_or_reject(rows, write(number)).write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(_ROW_ERRORS).parquet(path)

    return handle
