"""Character n-grams of texts as whole numbers, counted inside tasks.

A term of one to three characters is a number of three times 21 bits, a character's code and 1 in each
and 0 where there is none, so that numbers are ordered as their terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BITS = 21
#: A space as a character of a term.
SPACE = ord(" ") + 1
#: Characters of a text that are counted at once.
PIECE = 1 << 20
#: Texts whose counts are sent together.
TEXTS = 200


def number(term: str) -> int:
    return sum((ord(c) + 1) << BITS * (2 - i) for i, c in enumerate(term))


def terms(numbers: np.ndarray) -> pa.Array:
    """The terms of numbers, as strings."""
    at = np.stack([numbers >> 2 * BITS, numbers >> BITS & (1 << BITS) - 1, numbers & (1 << BITS) - 1], axis=1) - 1
    there = at >= 0
    size = (there.astype(np.int32) + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000)).sum(axis=1)  # bytes of UTF-8
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = at[there].astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(ends), pa.py_buffer(data))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the 1- to 3-grams inside words that are padded with a space on either side, ascending, and their counts."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
    white = (code == 32) | (code >= 9) & (code <= 13)
    code, white = np.where(white, 32, code), np.concatenate([[False], white[1:] & white[:-1]])
    c = code[~white].astype(np.int64) + 1  # words between single spaces
    if len(c) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = np.full(int((c == SPACE).sum()) - 2, SPACE << 2 * BITS)  # a space between two words counts for both
    found = []
    for at in range(0, len(c), PIECE):
        p = c[at : at + PIECE + 2]
        one, two = p[:PIECE] << 2 * BITS, (p[:-1] << 2 * BITS | p[1:] << BITS)[:PIECE]
        three = (two[: max(0, len(p) - 2)] | p[2:])[p[1:-1] != SPACE]  # none has the end of a word in its middle
        found.append(np.unique(np.concatenate([one, two, three, shared[: 0 if at else None]]), return_counts=True))
    if len(found) == 1:
        return found[0]
    numbers, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return numbers, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, text) as batches of (row, term, n)."""
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            told = [counted(t) for t in b.column(1).slice(k, TEXTS).to_pylist()]
            row = np.repeat(np.arange(k, k + len(told)), [len(x) for x, _ in told])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), terms(np.concatenate([x for x, _ in told])), pa.array(np.concatenate([n for _, n in told]))],
                names=["row", "term", "n"],
            )


class Weights:
    """Texts as sparse vectors of length 1: (1 + ln n) * idf of the known terms."""

    def __init__(self, known: list[str], at: np.ndarray, idf: np.ndarray):
        numbers, self.size = np.array([number(t) for t in known], np.int64), max(1, len(known))
        order = np.argsort(numbers)
        order = order[idf[order] != 0]
        self.at, self.idf = np.append(at[order], 0), np.append(idf[order], 0.0)
        self.numbers = np.append(numbers[order], np.iinfo(np.int64).max)  # the last is no term's

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order, and weights."""
        numbers, n = counted(text)
        k = np.searchsorted(self.numbers, numbers)
        here = self.numbers[k] == numbers
        k, n = k[here], n[here]
        order = np.argsort(self.at[k])
        k, w = k[order], ((1 + np.log(n)) * self.idf[k])[order]
        return self.at[k], w / np.sqrt(w @ w) if len(w) else w

    def vectors(self, texts: pa.Array) -> pa.Array:
        """As a sparse vector lies in a table."""
        told = [self.of(t) for t in texts.to_pylist()]
        ends = pa.array(np.cumsum([0] + [len(w) for _, w in told]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *x]).astype(kind))) for kind, x in ((np.int32, [a for a, _ in told]), (np.float64, [w for _, w in told]))]
        same = [pa.array(np.zeros(len(told), np.int8)), pa.array(np.full(len(told), self.size, np.int32))]
        return pa.StructArray.from_arrays(same + lists, ["type", "size", "indices", "values"])
