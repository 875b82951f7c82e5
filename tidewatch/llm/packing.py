"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import given_back, slices, small_batches, written

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 2048
#: Bytes of texts whose chunks are looked up together, about.
TOGETHER_BYTES = 2 << 20
#: Chunks that the model encodes at once.
LEARN_CHUNKS = 4096
#: Tokens that one packing task deals with, about.
TASK_TOKENS = 1 << 27

#: One word of letters that Unicode normalisation and lower-casing map one to one.
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch


class WordCache:
    """Ids of white-space separated chunks, each encoded once while it stays in the cache.

    The vocabulary ends every word and drops white space, so a text's ids are those of its
    chunks in a row. Chunks of letters, with or without a full stop or comma behind, go to the
    model many at a time; the full tokenizer encodes all others.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.full.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self.marks = {m.encode(): self._encode([m])[0] for m in (".", ",")}
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        if len(self.known) + len(chunks) > self.most:
            self.known.clear()
        for at in range(0, len(chunks), LEARN_CHUNKS):
            self._learn(chunks[at : at + LEARN_CHUNKS])

    def _learn(self, chunks: list[bytes]) -> None:
        known, plain, marked, other = self.known, {}, [], []
        for c in chunks:
            body = c[:-1] if c[-1] in b".," else c
            word = body.decode()
            if _PLAIN(word):
                if body not in known:
                    plain[body] = word
                if len(body) < len(c):
                    marked.append(c)
            else:
                other.append(c)
        if plain:
            ids = np.array(self.words.encode_batch_fast([" ".join(plain.values()).lower()], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(plain):
                known.update(zip(plain, map(raw.__getitem__, map(slice, [0, *(4 * e for e in ends)], (4 * e for e in ends)))))
            else:  # a vocabulary whose words don't end as expected
                known.update(zip(plain, self._encode(list(plain.values()))))
        if other:
            known.update(zip(other, self._encode([c.decode() for c in other])))
        for c in marked:
            known[c] = known[c[:-1]] + self.marks[c[-1:]]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; none for a null text.

        Arrow splits the texts and numbers their distinct chunks, so that each is looked up once a batch. A text
        with a special token's literal, in whatever case, goes to the full tokenizer as it is.
        """
        lower = pc.ascii_lower(pc.fill_null(texts, ""))
        whole = np.zeros(len(lower), bool)
        for token in self.added:
            whole |= pc.match_substring(lower, token.decode()).to_numpy(zero_copy_only=False)
        if whole.any():
            lower = pc.if_else(pa.array(whole), "", lower)
        split = pc.ascii_split_whitespace(lower)
        chunks = split.flatten().dictionary_encode()
        length = pc.binary_length(chunks.dictionary).to_numpy()
        stop = np.cumsum(length)
        held = chunks.dictionary.buffers()[2].to_pybytes() if length.any() else b""
        words = list(map(held.__getitem__, map(slice, (stop - length).tolist(), stop.tolist())))
        # white space before and behind a text leaves empty chunks
        self.known[b""] = b""
        got = list(map(self.known.get, words))
        late = [i for i, v in enumerate(got) if v is None]
        if late:
            self.learn([words[i] for i in late])
            for i in late:
                got[i] = self.known[words[i]]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        start, place = np.cumsum(size) - size, chunks.indices.to_numpy()
        many = size[place]
        ends = np.cumsum(many)
        at = np.arange(many.sum())
        at += np.repeat(start[place] - (ends - many), many)
        raw = np.frombuffer(b"".join(got), "<u4")[at].tobytes()
        del at
        cuts = np.append(0, 4 * ends)[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))].tolist()
        ids = [raw[a:z] for a, z in zip(cuts, cuts[1:])]
        special = np.flatnonzero(whole).tolist()
        if special:
            for i, raw in zip(special, self._encode([texts[i].as_py() for i in special])):
                ids[i] = raw
        return ids


_CACHES: dict[str, WordCache] = {}


def tokenizer(path: str) -> WordCache:
    """The worker's tokenizer for a vocabulary file; a task empties its cache when it ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of several batches at a time, as larger ones share more chunks."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER_BYTES:
            yield pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])
            held, size = [], 0
    if held:
        yield pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])


def pieces(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Each document's ids and an end id, cut after every ``length``: (doc_id, piece, start, length, ids_crc32)."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokenizer(vocabulary)
        try:
            for ids, texts in _together(slices(it)):
                rows = []
                for d, raw in zip(ids.to_pylist(), cache.ids(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * length)):
                        part = raw[at : at + 4 * length]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = zip(*rows) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )
        finally:  # the worker may run other stages for long
            cache.known.clear()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return given_back(tokenized(it))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(texts).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int = SEQUENCE, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """Online best-fit with a fixed number of open bins: (bin, offset) of each length.

    Bit f of ``free`` says that some open bin has f free. The lowest bit at or above a length is
    its best fit. When a new bin would be one too many, the fullest open one closes.
    """
    free, held, opened, made = 0, {}, 0, 0
    for n in lengths:
        if n >= capacity:
            yield made, 0
            made += 1
            continue
        fit = free >> n
        if fit:
            f = n + ((fit & -fit).bit_length() - 1)
            b = held[f].pop()
            if not held[f]:
                free ^= 1 << f
            opened -= 1
        else:
            if opened == open_bins:
                least = (free & -free).bit_length() - 1
                held[least].pop()
                if not held[least]:
                    free ^= 1 << least
                opened -= 1
            f, b = capacity, made
            made += 1
        yield b, capacity - f
        if f > n:
            held.setdefault(f - n, []).append(b)
            free |= 1 << (f - n)
            opened += 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    task_tokens: int = TASK_TOKENS,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens, one row per piece.

    Only documents longer than a sequence are cut. Texts are tokenized where they lie; the
    narrow rows of pieces are written to the shared folder and dealt by a hash to as many tasks
    as their tokens need, each of which packs its own in hash order. Null and empty texts are
    one end id. Rows that share an id, a null one too, are packed one by one. An empty table
    gives an empty result; other columns are not looked at.
    """
    made = written(pieces(docs, vocabulary, id_col=id_col, text_col=text_col, length=length, end_id=end_id), "pieces")
    total = made.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    order = ["__h", "doc_id", "piece", "start", "length", "ids_crc32"]
    # a document's pieces may lie in different tasks; only the lengths matter to the packing
    dealt = made.withColumn("__h", F.xxhash64(F.lit(11), "doc_id", "piece", "ids_crc32"))
    # equal rows hash alike; their places deal them to all tasks
    dealt = dealt.withColumn("__task", F.pmod(F.xxhash64("__h", F.monotonically_increasing_id()), F.lit(tasks)).cast("int"))
    dealt = dealt.repartition(tasks, "__task").sortWithinPartitions("__task", *order)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[object] = [None, None]

        def lengths() -> Iterator[int]:
            while True:
                yield now[1]

        packer: Iterator[tuple[int, int]] | None = None
        for b in it:
            bins, offsets = [], []
            for task, n in zip(b.column("__task").to_pylist(), b.column("length").to_pylist()):
                if task != now[0]:
                    now[0], packer = task, best_fit(lengths(), length, open_bins)
                now[1] = n
                k, at = next(packer)
                bins.append((task << 40) + k)
                offsets.append(at)
            keep = [b.column(c) for c in order[1:]]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], [*order[1:], "sequence_id", "offset"]
            )

    return dealt.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
