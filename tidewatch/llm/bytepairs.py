"""Byte-level BPE: texts to token ids and back, with the ranks of a public vocabulary file.

A long text is cut into chunks that overlap. Each is pre-tokenised by itself, wherever it lies;
two neighbours are stitched at the first place of their overlap where both have a pre-token's
boundary, and what lies between two such places is encoded by itself.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10


class Codec:
    """A worker's encoder and decoder for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = np.empty(max(ranks.values()) + 1, object)
        self.tokens[:] = b""
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        try:
            ids = self.encoding.encode_ordinary(text)
        except BaseException as e:  # the library's matcher gives up on a million spaces in a row
            if type(e).__name__ != "PanicException":
                raise
            ids = [i for m in self.pattern.finditer(text) for i in self.encoding._encode_single_piece(m[0])]
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes in a row."""
        return b"".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())

    def boundaries(self, text: str, until: int) -> Iterator[int]:
        """The places up to ``until`` at which a pre-token of this text starts and a stitch may lie.

        These are where one kind of characters (letters, numbers, others) ends and another starts,
        so that the text before has no say in what follows: not behind white space, which looks
        ahead, nor behind an apostrophe, which takes letters along. Characters that this Python
        doesn't know are left alone, as the encoder's tables may be of another version.
        """
        for m in self.pattern.finditer(text):
            at = m.start()
            if at > until:
                return
            if at and _kind(text[at - 1]) not in "CZ" and text[at - 1] != "'" and _kind(text[at]) not in ("C", _kind(text[at - 1])):
                yield at


def _kind(char: str) -> str:
    """L, N, Z (white space), C (unknown to this Python) or O for all others."""
    if char.isspace():
        return "Z"
    major = unicodedata.category(char)
    return "C" if major == "Cn" else major[0] if major[0] in "LN" else "O"


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Whole texts as token ids: ``doc_id``, ``n_tokens long``, ``ids binary`` (little-endian, 32 bits each).

    Every match of ``pattern`` is encoded by itself by the ranks in ``vocabulary``, a file of
    base64 tokens and ranks; there are no special tokens. Texts of at most ``chunk`` characters
    are encoded where they lie. Longer ones are cut, and their chunks dealt to all tasks, written
    to the shared folder and stitched; chunks without a stitch between them are encoded together,
    so that the result is that of the whole text. Null and empty texts have no tokens. Rows that
    share an id, a null one too, stay rows of their own; an empty table gives an empty result;
    other columns are not looked at.
    """
    if not 4 <= overlap < chunk:
        raise ValueError("the overlap is 4 characters at least and shorter than a chunk")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = _kind_of(texts, "doc_id")
    long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for b in slices(batches, rows=1 << 14):
            ids = [own.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches, rows=64):
            for i, text in enumerate(b.column(1).to_pylist()):
                row += 1
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for k, at in enumerate(starts):
                    part = [text[at : at + chunk + overlap]]
                    cells = [pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([len(starts)], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cells, b.column(0).slice(i, 1), pa.array(part)], ["row", "k", "parts", "doc_id", "text"])

    short = texts.where(~long).mapInArrow(whole, f"doc_id {kind}, ids binary")
    chunks = texts.where(long).mapInArrow(cut, f"row long, k int, parts int, doc_id {kind}, text string")
    chunks = written(chunks.repartition("row", "k"), "chunks")
    joined = _stitched(chunks, vocabulary, pattern, chunk, overlap)
    return short.unionByName(joined).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _stitched(chunks: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of the texts whose chunks these are."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for b in slices(batches, rows=256):
            heads, tails = [], []
            for text, k, parts in zip(*(b.column(c).to_pylist() for c in ("text", "k", "parts"))):
                # what a token cut off at the end would have been isn't known in the last characters
                known = len(text) - 4 if k + 1 < parts else -1
                at = list(own.boundaries(text, max(known, overlap)))
                heads.append([x for x in at if x <= overlap] if k else [])
                tails.append([x - chunk for x in at if chunk <= x <= known])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), *lists], ["row", "k", "head", "tail"])

    # two tables of short lists, written as both sides of the join read them
    found = written(chunks.select("row", "k", "parts", "text").mapInArrow(marks, "row long, k int, head array<int>, tail array<int>"), "marks")
    tails = found.select("row", (F.col("k") + 1).alias("k"), "tail")
    stitch = found.where("k > 0").select("row", "k", "head").join(tails, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("head", "tail")).alias("cut"))
    # a chunk belongs to the last one before it that starts at a stitch
    stitch = stitch.unionByName(found.where("k = 0").select("row", "k", F.lit(0).alias("cut")))
    group = F.max(F.when(F.col("cut").isNotNull(), F.col("k"))).over(_by_row())
    after = F.lead("cut").over(_by_row())
    stitch = stitch.select("row", "k", "cut", group.alias("g"), after.alias("next"))
    parts = chunks.join(stitch, ["row", "k"])
    alone = (F.col("g") == F.col("k")) & (F.col("next").isNotNull() | (F.col("k") + 1 == F.col("parts")))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for b in slices(batches, rows=256):
            cols = (b.column(c).to_pylist() for c in ("text", "cut", "end"))
            ids = [own.encode(text[cut : len(text) if end is None else end]) for text, cut, end in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*map(b.column, ("row", "g", "doc_id")), pa.array(ids, pa.binary())], ["row", "g", "doc_id", "ids"])

    # the text of a chunk ends at the next one's stitch, which is counted from that one's start
    end = F.when(F.col("next").isNotNull(), F.col("next") + chunk)
    single = parts.where(alone).select("row", "g", "doc_id", "text", "cut", end.alias("end"))
    several = parts.where(~alone).groupBy("row", "g", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "text", "cut", "next", "parts"))).alias("c")
    )
    last = F.element_at("c", -1)
    body = F.array_join(F.transform("c", lambda x: F.when(x.k + 1 == x.parts, x.text).otherwise(F.substring(x.text, 1, chunk))), "")
    # the last chunk's overlap lies behind the stitch, if there is one
    far = F.when(last.next.isNotNull(), (F.size("c") * chunk + last.next).cast("int"))
    tail = F.when(last.next.isNotNull(), F.expr(f"substring(element_at(c, -1).text, {chunk + 1})")).otherwise(F.lit(""))
    several = several.select("row", "g", "doc_id", F.concat(body, tail).alias("text"), F.col("c")[0].cut.alias("cut"), far.alias("end"))
    kind = _kind_of(chunks, "doc_id")
    ids = single.unionByName(several).mapInArrow(piece, f"row long, g int, doc_id {kind}, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("g", "ids")))
    return ids.groupBy("row", "doc_id").agg(ordered.alias("pieces")).select("doc_id", _concatenated("pieces").alias("ids"))


def _by_row():
    """A text's chunks in order: a short row for each chunk."""
    from pyspark.sql import Window

    return Window.partitionBy("row").orderBy("k")


def _concatenated(pieces: str) -> Column:
    """The pieces' ids in a row; joined as hexadecimal text, as arrays of binaries can't be."""
    return F.unhex(F.array_join(F.transform(pieces, lambda x: F.hex(x.ids)), ""))


def decode(coded: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows without their ids, and the bytes that these stand for; null ids give null.

    A column named as ``out`` is replaced. An id outside the vocabulary is an error.
    """
    keep = [c for c in coded.columns if c not in (ids_col, out)]
    inner = [f"c{i}" for i in range(len(keep))]  # names with dots can't be told from fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for b in slices(batches, rows=1 << 14):
            raw = [None if x is None else own.decode(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(raw, pa.binary())], [*inner, "raw"])

    chosen = coded.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], F.col(f"`{ids_col}`").alias("ids"))
    form = ", ".join([*(f"{i} {_kind_of(chosen, i)}" for i in inner), "raw binary"])
    return chosen.mapInArrow(run, form).toDF(*keep, out)
