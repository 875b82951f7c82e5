"""Media columns: payloads stored as 8-bit images in archives, read back with their features."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.archive import FORMAT, ArchiveSource, qualified
from tidewatch.llm.common import scratch_path, slices, small_batches

#: Samples of a row; payloads are padded to whole rows with PAD, a byte that UTF-8 never has.
WIDTH = 576
PAD = b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None, width: int = WIDTH) -> bytes:
    """A text's UTF-8 bytes, padded to a positive multiple of the width."""
    raw = (text or "").encode(errors="surrogatepass")
    return raw + PAD * (-len(raw) % width if raw else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(samples: bytes, n_bytes: int, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of the samples. A private chunk holds the length before padding."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)  # each row starts with filter 0
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    length = struct.pack(">Q", n_bytes)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"unPd", length) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int, int]:
    """The samples, the length before padding and the width; ValueError if a chunk is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, parts, data = 8, {}, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        data.append(body) if kind == b"IDAT" else parts.update({kind: body})
        at += 12 + n
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes(), struct.unpack(">Q", parts[b"unPd"])[0], width


def feature(samples: bytes, width: int) -> str:
    """Size, mean, spread, mean change along a row, and the shares of four bands of brightness."""
    x = np.frombuffer(samples, np.uint8)
    bands = np.bincount(x >> 6, minlength=4) * 1000 // x.size
    step = np.abs(np.diff(x.reshape(-1, width).astype(np.int16), axis=1)).mean()
    return f"{width}x{x.size // width};mean={x.mean():.3f};std={x.std():.3f};step={step:.3f};bands={','.join(map(str, bands))}"


def store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one image a row to archives below ``path``; members are named by id and number."""
    spark = small_batches(docs).sparkSession
    spark.dataSource.register(ArchiveSource)

    def run(it):
        n = 0
        for b in slices(it):
            names, media = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = payload(t)
                names.append(f"{'null' if d is None else d}.{n}.png")
                media.append(encode(raw, len((t or "").encode(errors="surrogatepass"))))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["member", "media"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = texts.mapInArrow(run, "member string, media binary")
    made.write.format(FORMAT).mode("append").option("path", qualified(spark, path)).save()


def load(spark, path: str, **options: int) -> DataFrame:
    """(doc_id, media) of every member of the archives below ``path``."""
    spark.dataSource.register(ArchiveSource)
    found = spark.read.format(FORMAT).option("path", qualified(spark, path)).options(**options).load()
    return found.select(F.expr("try_cast(substring_index(member, '.', 1) AS BIGINT)").alias("doc_id"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Decode (doc_id, media) and compute what the stored samples say, one row a member."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(it):
        for b in slices(it):
            rows = []
            for d, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                raw, n, width = decode(m)
                rows.append(
                    (d, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(raw, width))
                )
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return small_batches(media).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as an image in the shared folder, read it back and describe it.

    Null and empty texts are one row of padding. Equal texts give equal media and values. Rows
    that share an id are members of their own; a null id comes back as null; an empty table
    gives an empty result; other columns are not stored.
    """
    path = scratch_path(docs.sparkSession, "media")
    store(docs, path, id_col=id_col, text_col=text_col)
    return describe(load(docs.sparkSession, path))
