"""Vector codes: each part of a vector becomes the number of the nearest entry of its codebook.

The codebooks are trained in rounds. A round broadcasts a kd-tree for each, whose size the number
of entries bounds; tasks find every part's nearest entry by branch and bound and add up the parts
of each entry, and the sums of all tasks make the next codebooks. All numbers are whole, so that
the result doesn't depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components lie within 2^24 on both sides of zero, so that sums of squares stay whole numbers of 64 bits.
MOST = 1 << 24
#: Entries of a leaf.
LEAF = 32
#: Vectors that are looked up together.
ROWS = 4096


class KdTree:
    """Entries of a codebook halved at the median of their widest component, with the box of each node."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | np.ndarray] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, held: np.ndarray) -> int:
        node, points = len(self.below), self.entries[held]
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.below.append(held)
        widths = self.high[node] - self.low[node]
        if len(held) > LEAF and widths.any():
            order = held[np.argsort(points[:, widths.argmax()], kind="stable")]
            half = len(order) // 2
            # entries in ascending order, so that the first of equally near ones has the lowest index
            self.below[node] = (self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])))
        return node

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of the node can have."""
        q = self.queries[rows]
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def _apart(self, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Squared distances of queries from entries, exact as whole numbers."""
        if self.exact:
            # below 2^53 doubles hold every whole number, so that products of matrices round nothing
            held = self.entries[held].astype(float)
            q = self.queries[rows].astype(float)
            return np.einsum("ij,ij->i", q, q)[:, None] - 2 * (q @ held.T) + np.einsum("ij,ij->i", held, held)
        gap = self.queries[rows, None, :] - self.entries[held]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, the lowest index of equally near ones."""
        self.queries = queries
        most = max((int(np.abs(x).max()) for x in (queries, self.entries) if x.size), default=0)
        self.exact = 4 * queries.shape[1] * most * most < 1 << 53
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.index = np.full(len(queries), len(self.entries))
        if len(queries):
            self._visit(0, np.arange(len(queries)))
        return self.index, self.best

    def _visit(self, node: int, rows: np.ndarray) -> None:
        below = self.below[node]
        if isinstance(below, np.ndarray):
            apart = self._apart(rows, below)
            at = apart.argmin(axis=1)
            apart, index = apart[np.arange(len(rows)), at].astype(np.int64), below[at]
            nearer = (apart < self.best[rows]) | ((apart == self.best[rows]) & (index < self.index[rows]))
            self.best[rows[nearer]], self.index[rows[nearer]] = apart[nearer], index[nearer]
            return
        bounds = [self._bound(child, rows) for child in below]
        left_first = bounds[0] <= bounds[1]
        for child, bound, chosen in ((0, bounds[0], left_first), (1, bounds[1], ~left_first), (1, bounds[1], left_first), (0, bounds[0], ~left_first)):
            # a node as near as the best so far may hold an equally near entry of a lower index
            open_rows = rows[chosen & (bound <= self.best[rows])]
            if len(open_rows):
                self._visit(below[child], open_rows)


@dataclass
class Codebooks:
    """Entries by part, entry and position within the part, as whole numbers."""

    entries: np.ndarray

    def trees(self) -> list[KdTree]:
        return [KdTree(part) for part in self.entries]

    def sha256(self) -> str:
        """Of all components as decimal numbers, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, *, vector_col: str = "embedding", parts: int = PARTS) -> DataFrame:
    """Rows whose vector isn't null, holds finite numbers alone and falls into so many equal parts."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~odd)


def _parts(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """The scaled whole components of a batch: (row, part, position)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        whole = np.floor(np.clip(flat * SCALE, -MOST, MOST)).astype(np.int64)
    return whole.reshape(-1, parts, dims // parts)


def train(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codebooks | None:
    """The codebooks after so many rounds over all usable rows; None without one.

    They start as the parts of the vectors with the smallest ids (null ids last, equal ids by
    their vectors). The first of them sets the length; vectors of another one take no part.
    Components become floor(1024 x), within 2^24 on both sides of zero. An entry that is nobody's
    nearest stays. Only the codebooks and one row of sums per entry pass through the driver.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, vector_col=vector_col, parts=parts)
    kept = kept.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0].v)
    first = [r.v for r in first if len(r.v) == dims]
    column = pa.array(first, pa.list_(pa.float64()))
    books = Codebooks(np.ascontiguousarray(_parts(column, dims, parts).transpose(1, 0, 2)))
    same = kept.where(F.size("v") == dims).select("v")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books.trees())

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trees = shared.value
            size = len(trees[0].entries)
            counts = np.zeros((parts, size), np.int64)
            sums = np.zeros((parts, size, dims // parts), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    whole = _parts(b.column(0).slice(at, ROWS), dims, parts)
                    for k, tree in enumerate(trees):
                        index, _ = tree.nearest(whole[:, k])
                        counts[k] += np.bincount(index, minlength=size)
                        np.add.at(sums[k], index, whole[:, k])
            k, e = np.nonzero(counts)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[k, e].ravel()), dims // parts).cast(pa.list_(pa.int64()))
            cells = [pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[k, e]), lists]
            yield pa.RecordBatch.from_arrays(cells, ["part", "entry", "n", "sums"])

        found = same.mapInArrow(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        total = found.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims // parts)]).alias("sums"))
        after = books.entries.copy()
        for r in total.collect():  # a row for each entry at most
            after[r.part, r.entry] = [s // r.n for s in r.sums]
        books = Codebooks(after)
        shared.destroy()
    return books


def encode(vectors: DataFrame, books: Codebooks, *, keep: list[str], vector_col: str = "embedding") -> DataFrame:
    """The kept columns of all usable rows, ``code binary`` (a byte per part) and ``error long``.

    ``error`` is the sum of the parts' squared distances from their entries. Vectors of another
    length than the codebooks' are left out, as are those that ``usable`` leaves out.
    """
    parts, size, width = books.entries.shape
    if size > 256:
        raise ValueError("a byte numbers 256 entries")
    shared = vectors.sparkSession.sparkContext.broadcast(books.trees())
    kept = usable(vectors, vector_col=vector_col, parts=parts).where(F.size(vector_col) == parts * width)
    inner = [f"c{i}" for i in range(len(keep))]  # names with dots can't be told from fields
    kept = kept.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                whole = _parts(b.column(len(keep)), parts * width, parts)
                code, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
                for k, tree in enumerate(trees):
                    index, apart = tree.nearest(whole[:, k])
                    code[:, k] = index
                    error += apart
                raw = code.tobytes()
                codes = pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), codes, pa.array(error)], [*inner, "code", "error"])

    form = "".join(f"{i} {kept.schema[i].dataType.simpleString()}, " for i in inner)
    return kept.mapInArrow(run, f"{form}code binary, error long").toDF(*keep, "code", "error")
