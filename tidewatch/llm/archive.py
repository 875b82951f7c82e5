"""A Spark data source over ZIP archives: byte-range partitions, Arrow batches, retries by member."""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "tidewatch_archive"
_LOCAL = struct.Struct("<4s5H3L2H")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop gives it, as a URI."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file:///" + full[5:].lstrip("/") if full.startswith("file:") else full


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveSource(DataSource):
    """Members of the archives below a folder: (member, offset, media), written from (member, media).

    Options: ``path``, a URI; ``range_bytes``, the bytes of a partition; ``archive_bytes``, those
    of an archive; ``batch_bytes``, those of an Arrow batch; ``retries`` of a member.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options), schema.fieldNames())


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the committed archives' bytes. Only names and sizes are read here."""
        store, base = pafs.FileSystem.from_uri(self.path)
        found = []
        for info in sorted(store.get_file_info(pafs.FileSelector(base)), key=lambda i: i.path):
            if info.base_name.startswith("_commit-"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [
            ByteRange(name, at, min(at + self.range_bytes, size))
            for name, size in found
            for at in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Members whose header starts in the range, found in the archive's directory."""
        if not partition.archive:
            return
        store, base = pafs.FileSystem.from_uri(self.path)
        where = f"{base}/{partition.archive}"
        with store.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            members = [
                (i.header_offset, i.compress_size, i.CRC, i.filename)
                for i in z.infolist()
                if partition.start <= i.header_offset < partition.end
            ]
        held, size = [], 0
        handle = [store.open_input_file(where)]
        for offset, length, crc, name in sorted(members):
            held.append((name, offset, self._member(store, where, handle, offset, length, crc, name)))
            size += length
            if size >= self.batch_bytes:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _member(self, store, where: str, handle: list, offset: int, length: int, crc: int, name: str) -> bytes:
        """One stored member, read again from its offset if reading fails or its checksum differs."""
        for attempt in range(self.retries + 1):
            try:
                head = _LOCAL.unpack(handle[0].read_at(_LOCAL.size, offset))
                if head[0] != b"PK\x03\x04":
                    raise OSError("no member starts here")
                data = handle[0].read_at(length, offset + _LOCAL.size + head[9] + head[10])
                if len(data) != length or zlib.crc32(data) != crc:
                    raise OSError("the member's checksum differs")
                return data
            except (OSError, struct.error) as e:
                if attempt == self.retries:
                    raise OSError(f"{where}, member {name} at {offset}: {e}") from e
                time.sleep(0.05 * 2**attempt)
                handle[0] = store.open_input_file(where)
        raise AssertionError


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    names, offsets, media = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())],
        ["member", "offset", "media"],
    )


class ArchiveWriter(DataSourceArrowWriter):
    """Each task stores its members in archives of its own; a commit file names those that count."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.path = options["path"]
        self.archive_bytes = int(options.get("archive_bytes", 64 << 20))
        self.columns = names.index("member"), names.index("media")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = pafs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        out = archive = None
        name = ""

        def close() -> None:
            archive.close()
            done.append((name, out.tell()))
            out.close()

        for batch in iterator:
            for member, media in zip(batch.column(self.columns[0]).to_pylist(), batch.column(self.columns[1]).to_pylist()):
                if archive is None:
                    # a name of its own for each attempt, so that a lost one leaves nothing that counts
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(member), media)
                if out.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        key = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/.pending-{key}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        store.move(f"{base}/.pending-{key}", f"{base}/_commit-{key}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        for name, _ in [a for m in messages if m for a in m.archives]:
            store.delete_file(f"{base}/{name}")
