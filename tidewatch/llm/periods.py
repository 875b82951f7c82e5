"""Periodic runs: stretches of words that repeat themselves at least three times in a row.

The grid is harmonic: a run with period p covers at least two neighbouring multiples of p, so for
every p the words at jp and (j+1)p are compared forwards and backwards, n/1 + n/2 + n/3 + ... pairs
in all. Longest common extensions come from suffix arrays of the words and of the reversed words,
with their common prefix lengths and range minima.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices

LEAST, TIMES = 24, 3
#: Words that one suffix array is made of, about; a longer text has one of its own.
ARRAY_WORDS = 1 << 17
#: Grid pairs looked at together.
GRID_PAIRS = 1 << 20
_BLOCK = 32


class RangeMin:
    """Minima of ranges in linear memory: blocks of 32, prefix and suffix minima in each, a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // _BLOCK)
        self.values = np.full(blocks * _BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        square = self.values.reshape(blocks, _BLOCK)
        self.up = np.minimum.accumulate(square, axis=1).ravel()
        self.down = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of each range, both ends included."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.down[low], self.up[high])
        span = last - first - 1
        far = np.flatnonzero(span > 0)
        levels = np.frexp(span[far].astype(float))[1] - 1
        for level in np.unique(levels):
            at = far[levels == level]
            t = self.table[level]
            out[at] = np.minimum(out[at], np.minimum(t[first[at] + 1], t[last[at] - (1 << int(level))]))
        same = np.flatnonzero(span < 0)
        for at in np.array_split(same, len(same) // 65536 + 1):
            cells = low[at, None] + np.arange(_BLOCK)
            inside = cells <= high[at, None]
            cells[~inside] = 0
            out[at] = np.where(inside, self.values[cells], np.iinfo(self.values.dtype).max).min(axis=1)
        return out


class Suffixes:
    """The suffix array of a sequence of numbers, by doubling, and the lengths that neighbours in it share.

    Two neighbours parted in the round of length h share h numbers and what the suffixes h further
    on share, which an earlier round has settled.
    """

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        first = np.ones(n, bool)
        first[1:] = numbers[order[1:]] != numbers[order[:-1]]
        shared = np.where(first, 0, n)
        starts = np.flatnonzero(first)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(starts, np.diff(starts, append=n))
        length = 1
        while True:
            tied = ~first
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            suffix = order[at]
            behind = np.where(suffix + length < n, rank[np.minimum(suffix + length, n - 1)], -1)
            group = rank[suffix]
            resorted = np.argsort(group * (n + 1) + behind + 1, kind="stable")
            suffix, behind, group = suffix[resorted], behind[resorted], group[resorted]
            order[at] = suffix
            parted = np.flatnonzero((behind[1:] != behind[:-1]) & (group[1:] == group[:-1])) + 1
            low, high = behind[parted - 1], behind[parted]
            more = np.zeros(len(parted), np.int64)
            inner = np.flatnonzero(low >= 0)
            if len(inner):
                more[inner] = RangeMin(shared)(low[inner] + 1, high[inner])
            shared[at[parted]] = length + more
            first[at[parted]] = True
            rank[suffix] = np.maximum.accumulate(np.where(first[at], at, 0))
            length *= 2
        self.rank, self.least = rank, RangeMin(shared)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from a and from b on are equal, for different a and b."""
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _window(least: int, times: int) -> int:
    """So many words are equal at least behind a run's first grid point and one period on, as a power of two.

    The first multiple of p in a run lies less than p behind its start, so that of max(least, times * p)
    words all but 2p - 1 follow the second multiple.
    """
    fewest = min(max(least, times * p) - 2 * p + 1 for p in range(1, least + 2))
    return 1 << max(fewest.bit_length() - 1, 0)


def _fingerprints(numbers: np.ndarray, width: int) -> np.ndarray:
    """A number for each stretch of ``width`` words; equal stretches have equal ones."""
    out = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(31)
    step = 1
    while step < width:
        out[:-step] = out[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + out[step:]
        step *= 2
    return out


def _grid(prints: np.ndarray, n: int, width: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid pairs (jp, p) of one text whose next words may be equal to those one period on."""
    most, p = n - width, 1
    while p <= min(n // times, most):
        # periods with about GRID_PAIRS pairs together
        to = min(n // times, most, p + max(0, GRID_PAIRS * p // most - 1))
        periods = np.arange(p, to + 1)
        counts = most // periods
        ends = np.cumsum(counts)
        period = np.repeat(periods, counts)
        left = (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * period
        hit = np.flatnonzero(prints[left] == prints[left + period])
        if len(hit):
            yield left[hit], period[hit]
        p = to + 1


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The maximal runs of each list of words as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = defaultdict(count().__next__)
    numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    found = [np.empty((0, 3), np.int64)] * len(texts)
    width = _window(least, times)
    if not len(numbers):
        return found
    prints = _fingerprints(numbers, width)
    open_texts, pairs, held = [], [], 0

    def settle() -> None:
        nonlocal held
        for i, rows in _extended(numbers, len(number), [(i, begins[i], sizes[i]) for i in open_texts], pairs, least, times):
            found[i] = rows
        open_texts.clear()
        pairs.clear()
        held = 0

    for i in np.flatnonzero(sizes >= least):
        n, at = int(sizes[i]), int(begins[i])
        own = prints[at : at + n - width + 1]
        # a text without a repeated stretch has no pair
        ordered = np.sort(own)
        if not (ordered[1:] == ordered[:-1]).any():
            continue
        got = list(_grid(own, n, width, times))
        if got:
            if held and held + n > ARRAY_WORDS:
                settle()
            open_texts.append(i)
            pairs.append(tuple(map(np.concatenate, zip(*got))))
            held += n
    if open_texts:
        settle()
    return found


def _extended(numbers, used, texts, pairs, least, times) -> Iterator[tuple[int, np.ndarray]]:
    """Extends the pairs of several texts, laid end to end with numbers of their own between them."""
    parts, at, places = [], 0, []
    for k, (_, begin, n) in enumerate(texts):
        parts += [numbers[begin : begin + n], [used + k]]
        places.append(at)
        at += n + 1
    line = np.concatenate(parts)
    forward, backward = Suffixes(line), Suffixes(line[::-1].copy())
    text = np.repeat(np.arange(len(texts)), [len(left) for left, _ in pairs])
    base = np.array(places)[text]
    left = np.concatenate([left for left, _ in pairs]) + base
    period = np.concatenate([p for _, p in pairs])
    end = left + period + forward.extension(left, left + period)
    before = np.flatnonzero(left > 0)
    start = left.copy()
    last = len(line) - 1
    start[before] -= backward.extension(last - (left[before] - 1), last - (left[before] + period[before] - 1))
    length = end - start
    keep = np.flatnonzero(length >= np.maximum(least, times * period))
    # a stretch found with several periods has the smallest
    keep = keep[np.lexsort((period[keep], end[keep], start[keep]))]
    new = np.ones(len(keep), bool)
    new[1:] = (start[keep[1:]] != start[keep[:-1]]) | (end[keep[1:]] != end[keep[:-1]])
    keep = keep[new]
    rows = np.stack([start[keep] - base[keep], length[keep], period[keep]], axis=1)
    for k, (i, _, _) in enumerate(texts):
        own = rows[text[keep] == k]
        yield i, own[np.lexsort((own[:, 2], own[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words in a line, without those that some run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document its words' maximal periodic runs, and its text without the repetitions.

    Returns ``doc_id``, ``n_words long``, ``runs array<struct<start, length, period>>`` (numbers of
    words, by start, then period) and ``collapsed string``. Words stand between ASCII white space.
    A run is as long as ``least`` words and ``times`` (2 or more) of its smallest period, and no
    neighbouring word extends it. Texts stay in their tasks, nothing is shuffled. Null, empty and
    blank texts have no words, no runs and an empty ``collapsed``. A very long text has suffix
    arrays of its own, linear in its words. Rows that share an id, a null one too, stay rows of
    their own; an empty table gives an empty result; other columns are not looked at.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=1 << 14):
            texts = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            found = find_runs(texts, least, times)
            flat = np.concatenate(found)
            ends = np.cumsum([0, *map(len, found)])
            cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells).cast(kind)
            kept = pa.array(list(map(collapsed, texts, found)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, texts)), pa.int64()), lists, kept], ["doc_id", "n_words", "runs", "collapsed"]
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    form = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {form}")
