"""A topic kept in files, read and written as a stream: a broker's log without the broker.

A log is a folder of Parquet segments, each with one partition's messages in order, and of
manifests, one a batch, that list the segments with the offset of their first message. A batch is
there once its manifest is, so that readers see whole batches only, and a batch that a writer
repeats isn't there twice. Messages have the broker's columns.

    logs.register(spark)
    spark.readStream.format("topic_log").option("path", folder).load()
    rows.writeStream.format("topic_log").option("path", folder).option("partitions", 6).start()
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

MESSAGE = "topic string, partition int, offset long, timestamp timestamp, key binary, value binary"
#: Messages of a segment that one task reads at most.
SLICE = 1 << 20
_STORED = pa.schema([("timestamp", pa.timestamp("us", tz="UTC")), ("key", pa.binary()), ("value", pa.binary())])


@dataclass
class Segment:
    """A file of one partition's messages from the offset ``first`` on; times are its least and greatest, in microseconds."""

    file: str
    partition: int
    first: int
    count: int
    since: int
    until: int


class Log:
    """The manifests of a log. Only one writer may add to it at a time; readers may be many."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path.rstrip("/"))
        self._batches: dict[int, list[Segment]] = {}

    def _manifest(self, batch: int) -> str:
        return f"{self.root}/_log/{batch:020d}.json"

    def batches(self) -> dict[int, list[Segment]]:
        """The segments by batch; manifests that were read before aren't read again."""
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/_log", allow_not_found=True)):
            name = f.base_name.removesuffix(".json")
            if name.isdigit() and int(name) not in self._batches:
                with self.fs.open_input_stream(f.path) as s:
                    self._batches[int(name)] = [Segment(**x) for x in json.load(s)]
        return self._batches

    def segments(self) -> list[Segment]:
        return [s for _, found in sorted(self.batches().items()) for s in found]

    def ends(self) -> dict[int, int]:
        """By partition the offset that its next message will have."""
        out: dict[int, int] = {}
        for s in self.segments():
            out[s.partition] = max(out.get(s.partition, 0), s.first + s.count)
        return out

    def add(self, batch: int, written: list[Segment]) -> bool:
        """Make a batch's segments visible; False, and nothing is changed, if the batch was there already."""
        if batch in self.batches():
            return False
        ends = self.ends()
        for s in written:
            s.first = ends.get(s.partition, 0)
            ends[s.partition] = s.first + s.count
        self.fs.create_dir(f"{self.root}/_log")
        draft = f"{self.root}/_log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(json.dumps([vars(s) for s in written]).encode())
        self.fs.move(draft, self._manifest(batch))
        return True

    def discard(self, written: list[Segment]) -> None:
        for s in written:
            self.fs.delete_file(f"{self.root}/{s.file}")

    def read(self, segment: str, first: int, low: int, high: int, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Batches of a segment's messages from the offset ``low`` up to ``high``, each with its first offset."""
        with self.fs.open_input_file(f"{self.root}/{segment}") as raw:
            file, at, groups = pq.ParquetFile(raw), first, []
            for g in range(file.num_row_groups):
                after = at + file.metadata.row_group(g).num_rows
                if after > low and at < high:
                    groups.append((g, at))
                at = after
            if groups:
                at = groups[0][1]
                for b in file.iter_batches(batch_size=4096, row_groups=[g for g, _ in groups], columns=columns):
                    skip = max(low - at, 0)
                    kept = b.slice(skip, max(min(high - at, b.num_rows) - skip, 0))
                    if kept.num_rows:
                        yield at + skip, kept
                    at += b.num_rows

    def since(self, us: int) -> dict[int, int]:
        """By partition the offset of its first message of that time or later, or its end without any."""
        out = self.ends()
        found: set[int] = set()
        for s in self.segments():
            if s.partition in found or s.until < us:
                continue
            for at, b in self.read(s.file, s.first, s.first, s.first + s.count, ["timestamp"]):
                late = [i for i, t in enumerate(b.column(0).cast(pa.int64()).to_pylist()) if t >= us]
                if late:
                    out[s.partition] = at + late[0]
                    found.add(s.partition)
                    break
        return out


@dataclass
class Slice(InputPartition):
    segment: str
    partition: int
    first: int
    low: int
    high: int


def _slices(log: Log, start: dict[int, int], end: dict[int, int]) -> list[Slice]:
    """What lies between two offsets of each partition, in pieces of ``SLICE`` messages at most."""
    out = []
    for s in log.segments():
        low, high = max(s.first, start.get(s.partition, 0)), min(s.first + s.count, end.get(s.partition, 0))
        out += [Slice(s.file, s.partition, s.first, at, min(at + SLICE, high)) for at in range(low, high, SLICE)]
    return out


def _read(options: dict[str, str], piece: Slice) -> Iterator[pa.RecordBatch]:
    log = Log(options["path"])
    for at, b in log.read(piece.segment, piece.first, piece.low, piece.high, ["timestamp", "key", "value"]):
        n = b.num_rows
        columns = [pa.array([options.get("topic", "topic")] * n), pa.array([piece.partition] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *b.columns], ["topic", "partition", "offset", "timestamp", "key", "value"])


class LogReader(DataSourceReader):
    """All messages that are there when the query is planned."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Slice]:
        log = Log(self.options["path"])
        return _slices(log, {}, log.ends())

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are one number a partition. At most ``limit`` messages a batch, shared out by what each partition has waiting.

    The engine doesn't tell where a batch will start when it asks for its end, so the end of the
    batch planned last is kept in the folder ``progress``, which only a limit needs, and each
    checkpoint one of its own: it is written whenever a batch is planned, and a batch that is
    repeated after a failure is planned again before the end of the next one is asked for.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.log = options, Log(options["path"])
        self.limit = int(options.get("limit", 0))
        if self.limit and "progress" not in options:
            raise ValueError("a limit needs a folder for its progress")
        self.begin: dict[int, int] | None = None
        self.position: dict[int, int] | None = None

    def initialOffset(self) -> dict:
        """Where a query without a checkpoint starts; the engine may ask for the first end before."""
        if self.begin is None:
            since = self.options.get("since_ms")
            self.begin = self.log.since(int(since) * 1000) if since else {}
        return self.begin

    def _progress(self) -> tuple[fs.FileSystem, str]:
        where, folder = fs.FileSystem.from_uri(self.options["progress"].rstrip("/"))
        where.create_dir(folder)
        return where, f"{folder}/planned.json"

    def latestOffset(self) -> dict:
        ends = self.log.ends()
        if not self.limit:
            return ends
        if self.position is None:
            where, file = self._progress()
            if where.get_file_info(file).type == fs.FileType.NotFound:
                self.position = self.initialOffset()
            else:
                with where.open_input_stream(file) as s:
                    self.position = _numbers(json.load(s))
        waiting = {p: end - self.position.get(p, 0) for p, end in ends.items() if end > self.position.get(p, 0)}
        total = sum(waiting.values())
        if total <= self.limit:
            return ends
        out, left = dict(self.position), self.limit
        for p, n in sorted(waiting.items()):
            # what the partitions before didn't take is there for the later ones, and some partition takes one at least
            share = min(left, n, max(1, self.limit * n // total))
            out[p] = self.position.get(p, 0) + share
            left -= share
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        start, end = _numbers(start), _numbers(end)
        self.log.batches()
        if self.limit:
            where, file = self._progress()
            with where.open_output_stream(f"{file}.new") as s:
                s.write(json.dumps(end).encode())
            where.move(f"{file}.new", file)
        self.position = end
        return _slices(self.log, start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        """Segments stay: others may read them."""


def _numbers(offset: dict) -> dict[int, int]:
    return {int(p): int(n) for p, n in offset.items()}


@dataclass
class Written(WriterCommitMessage):
    segments: list[Segment]


def _write(options: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's messages as a segment for each partition that it has some of, in the task's order."""
    log, count = Log(options["path"]), int(options.get("partitions", 1))
    files: dict[int, tuple[str, pq.ParquetWriter, Segment]] = {}
    name = uuid.uuid4().hex
    log.fs.create_dir(log.root)
    for b in batches:
        given = {c.lower(): b.column(i) for i, c in enumerate(b.schema.names)}
        keys = given["key"].cast(pa.binary())
        value = given["value"].cast(pa.binary())
        own = given.get("partition", pa.nulls(b.num_rows)).to_pylist()
        at = given.get("timestamp", pa.nulls(b.num_rows)).cast(_STORED.field(0).type)
        at = at.fill_null(pa.scalar(time.time_ns() // 1000, pa.int64()).cast(_STORED.field(0).type))
        dealt = [zlib.crc32(k or b"") % count if p is None else p for k, p in zip(keys.to_pylist(), own)]
        table = pa.table([at, keys, value], schema=_STORED)
        for p in sorted(set(dealt)):
            rows = table.filter(pa.array([x == p for x in dealt]))
            us = rows.column(0).cast(pa.int64()).to_pylist()
            if p not in files:
                file = f"{name}-{p}.parquet"
                files[p] = file, pq.ParquetWriter(f"{log.root}/{file}", _STORED, filesystem=log.fs), Segment(file, p, 0, 0, min(us), max(us))
            _, writer, segment = files[p]
            writer.write_table(rows)
            segment.count += len(us)
            segment.since, segment.until = min(segment.since, *us), max(segment.until, *us)
    for _, writer, _ in files.values():
        writer.close()
    return Written([s for _, _, s in files.values()])


def _segments(messages) -> list[Segment]:
    return [s for m in messages if m is not None for s in m.segments]


class LogStreamWriter(DataSourceStreamArrowWriter):
    """Adds each batch once: what a repeated one wrote anew is deleted."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.options, iterator)

    def commit(self, messages, batchId: int) -> None:
        log, written = Log(self.options["path"]), _segments(messages)
        if not log.add(batchId, written):
            log.discard(written)

    def abort(self, messages, batchId: int) -> None:
        Log(self.options["path"]).discard(_segments(messages))


class LogWriter(DataSourceArrowWriter):
    """Adds a frame as the batch after the last one."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.options, iterator)

    def commit(self, messages) -> None:
        log = Log(self.options["path"])
        log.add(max(log.batches(), default=-1) + 1, _segments(messages))

    def abort(self, messages) -> None:
        Log(self.options["path"]).discard(_segments(messages))


class TopicLog(DataSource):
    """Options: ``path``; to read ``topic`` (a name for the column), ``since_ms``, ``limit`` and ``progress``; to write ``partitions``.

    Rows to be written have ``key`` and ``value`` (strings or binaries), and may have ``partition``
    (else the key's CRC tells it) and ``timestamp`` (else the time of writing).
    """

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only added to")
        return LogWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TopicLog)
