"""SimHash near-duplicates: vantage-point tree shards of fingerprints, compared exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import jaccard
from tidewatch.llm.common import components, hash_sample, slices, small_batches, written

WORDS = 4
RADIUS = 4
#: Parts of a fingerprint with a tree each. Of two fingerprints within the radius some part
#: differs in a PARTS-th of it at most, so that boundaries overlap far less than in one tree.
PARTS = 3
SEED = 42
#: Fingerprints that the trees are fitted on: so many, or beyond that one in SAMPLED_ONE_IN, but not
#: more than TREE_SAMPLE_MOST, 8 MB. LEAF_ROWS are compared at once by a task.
TREE_SAMPLE = 65_536
SAMPLED_ONE_IN = 256
TREE_SAMPLE_MOST = 1 << 20
LEAF_ROWS = 8_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text: a bit is set if over half of the shingles' XXH64 have it.

    A-Z are lower-cased, ASCII white space separates words, shingles count as often as they
    occur. A text of fewer words is one shingle, one without words or null has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode(errors="surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""

    def run(it):
        for b in slices(it):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(texts).mapInArrow(run, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over the bits of ``mask``.

    Inner nodes by number have a vantage point, the distance that parts their two sides, and
    their children; leaves are ~number.
    """

    mask: int
    radius: int
    point: list[int] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: int = 0

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves. Rows nearer than the part go inside, others outside.

        Two rows within the radius differ by it at most in their distance to a vantage point, so
        of a pair on both sides the inner row lies that near to the boundary. Such rows go
        outside as well, and every pair within the radius meets in some leaf.
        """
        out_rows, out_leaves = [], []
        todo = [(0 if self.point else ~0, np.arange(fp.size))]
        while todo:
            node, rows = todo.pop()
            if not rows.size:
                continue
            if node < 0:
                out_rows.append(rows)
                out_leaves.append(np.full(rows.size, ~node))
                continue
            d = np.bitwise_count((fp[rows] ^ np.uint64(self.point[node])) & np.uint64(self.mask))
            todo.append((self.inner[node], rows[d < self.part[node]]))
            todo.append((self.outer[node], rows[d >= self.part[node] - self.radius]))
        if not out_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def fit_tree(sample: np.ndarray, leaf: int, mask: int, radius: int) -> Tree:
    """A vantage-point tree whose leaves get ``leaf`` rows of the sample at most, boundary rows included.

    Of some vantage points and parting distances the one with the smallest larger side is taken.
    A node stays a leaf if its rows can't be parted into two smaller sets.
    """
    rng, tree, bits = np.random.default_rng(5), Tree(mask, radius), np.uint64(mask)

    def grow(rows: np.ndarray) -> int:
        best = None
        if rows.size > leaf:
            for p in rng.choice(rows, min(8, rows.size), replace=False):
                d = np.bitwise_count((rows ^ p) & bits).astype(int)
                middle = int(np.median(d))
                for part in range(middle, middle + radius + 2):
                    size = max(int((d < part).sum()), int((d >= part - radius).sum()))
                    if best is None or size < best[0]:
                        best = size, int(p), part, d
        if best is None or best[0] > 0.9 * rows.size:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        _, p, part, d = best
        k = len(tree.point)
        for values, v in ((tree.point, p), (tree.part, part), (tree.inner, 0), (tree.outer, 0)):
            values.append(v)
        tree.inner[k] = grow(rows[d < part])
        tree.outer[k] = grow(rows[d >= part - radius])
        return k

    grow(sample)
    return tree


def part_masks(parts: int) -> list[int]:
    """The bits of 64 dealt into so many parts."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:])]


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius. Distances to a pivot bound which stretch of b a row of a can link with."""
    pivot = b[0]
    da, db = np.bitwise_count(a ^ pivot).astype(int), np.bitwise_count(b ^ pivot).astype(int)
    order = np.argsort(db, kind="stable")
    b, db = b[order], db[order]
    for d in np.unique(da):
        lo, hi = np.searchsorted(db, [d - radius, d + radius + 1])
        rows = np.flatnonzero(da == d)
        step = max(1, (1 << 20) // max(1, hi - lo))
        for at in range(0, rows.size, step):
            part = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a[part, None] ^ b[None, lo:hi]) <= radius)
            yield part[i], order[lo + j]


def near_pairs(prints: DataFrame, *, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, tree_sample: int = TREE_SAMPLE) -> DataFrame:
    """Links (a, b) that span the same groups as all pairs of ``prints(fp)`` within the radius.

    The trees are fitted on a bounded sample, which grows with the fingerprints up to
    ``TREE_SAMPLE_MOST`` so that leaves don't, and broadcast; every fingerprint is routed. A leaf
    with more rows than a task compares at once is dealt into blocks, and a task gets two blocks
    of it, so that no group of near copies, however large, meets in one task. Each task emits
    a spanning forest of the pairs that it found, at most one per row, each within the radius.
    """
    spark = prints.sparkSession
    rows = prints.count()
    drawn = hash_sample(prints, min(max(tree_sample, rows // SAMPLED_ONE_IN), TREE_SAMPLE_MOST), "fp")
    sample = np.array([r.fp for r in drawn.collect()], np.int64).view(np.uint64)
    scale = sample.size / max(rows, 1)
    parts = min(PARTS, radius + 1)
    trees = [fit_tree(sample, max(16, int(leaf_rows * scale)), m, radius // parts) for m in part_masks(parts)]
    shared = spark.sparkContext.broadcast(trees)

    def route(it):
        for b in it:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            at = 0
            for tree in shared.value:
                i, leaf = tree.route(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array((leaf + at).astype(np.int32))], ["fp", "leaf"])
                at += tree.leaves

    routed = written(prints.select("fp").mapInArrow(route, "fp long, leaf int"), "leaves")
    # the trees' leaves are bounded by the sample, and so is this table
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias("k"))
    dealt = routed.join(F.broadcast(blocks), "leaf").withColumn("own", F.pmod(F.xxhash64(F.lit(23), "fp"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("fp", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        fp = np.sort(fp).view(np.uint64)
        step = 1 << 14
        found = (
            (i + at, j + to)
            for at in range(0, fp.size, step)
            for to in range(at, fp.size, step)
            for i, j in linked(fp[at : at + step], fp[to : to + step], radius)
        )
        i, j = jaccard.spanning(fp.size, found)
        signed = fp.view(np.int64)
        return pa.table({"a": signed[i], "b": signed[j]})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Equal fingerprints are one node, so exact copies never multiply. Null and empty texts have
    fingerprint 0 and link like any other; rows that share an id stay rows of their own; a null
    id takes part, but never names a component unless all its members are null. An empty table
    gives an empty result; other columns are not looked at.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    group = components(near_pairs(nodes.select("fp"), radius=radius))
    # the smallest id of each component goes back to its fingerprints, then to their documents
    placed = nodes.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = _named(written(placed.select("fp", "first", "component"), "placed"), "fp")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _similar_sets(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node) of all rows, and (node, first, component) of each different set."""
    often = jaccard.frequent(docs, text_col)
    signs = written(jaccard.signatures(docs, often, id_col=id_col, text_col=text_col), "signatures")
    least = {c: F.min(c).alias(c) for c in ("digest", "n", "fp", "sketch", "wide")}
    nodes = written(signs.groupBy("node").agg(F.min("doc_id").alias("first"), *least.values()), "nodes")
    total = nodes.agg(F.sum(F.expr("n div 5 + 1"))).first()[0] or 0
    shared = written(jaccard.shared_rows(signs, total, often), "shared")
    # only sets that share a shingle of their prefixes can be similar
    met = written(nodes.join(shared.select("node").distinct(), "node").select("node", "fp", "sketch"), "met")
    by_print = written(met.groupBy("fp").agg(F.min("node").alias("lead")), "prints")
    close = near_pairs(by_print.select("fp"), radius=radius)
    for side in ("a", "b"):
        close = close.join(by_print.select(F.col("fp").alias(side), F.col("lead").alias(f"node_{side}")), side)
    close = close.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = met.join(by_print, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = jaccard.verified(close.unionAll(same), docs, nodes, text_col=text_col)
    for every in (False, True):
        pairs = jaccard.candidates(shared, met, components(links), every=every)
        links = links.unionAll(jaccard.verified(pairs, docs, nodes, text_col=text_col))
    group = components(links).withColumnRenamed("node", "__n")
    placed = nodes.join(group, F.col("node") == F.col("__n"), "left")
    rows = signs.select("doc_id", "digest", "node")
    return rows, written(placed.select("node", "first", F.coalesce("component", "node").alias("component")), "placed")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by texts whose five-word shingles are similar.

    Two texts link if the Jaccard similarity of their sets of shingles is 0.8 or more. The trees
    give the pairs of fingerprints of the sets within the radius, which join nearly all of a large
    group; as similar texts may differ in more bits than trees can part, the prefixes of the sets
    give the others across the groups so far. Every pair is checked by its whole sets, none is lost.

    Equal sets are one node; texts without words, null ones among them, are one too; a text of
    fewer words is one shingle. Rows that share an id stay rows of their own; a null id takes part,
    but never names a component unless all its members are null. Ties don't matter, as groups don't
    depend on any order. An empty table gives an empty result; other columns are not looked at.
    """
    rows, placed = _similar_sets(docs, id_col, text_col, radius)
    return rows.select("doc_id", "node").join(_named(placed, "node"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of :func:`similar`, with all its columns: the one with the smallest id.

    A null id is the largest; of rows with that id the one whose text has the least MD5 stays, and
    of rows equal in id and text any one. Other columns, whatever their names, come back as they are.
    """
    rows, placed = _similar_sets(docs, id_col, text_col, radius)
    rows = rows.join(placed.select("node", "component"), "node")
    rows = written(rows.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest", "n")).alias("best")
    kept = rows.groupBy("component").agg(best).select(F.col("best.doc_id").alias("__id"), F.col("best.digest").alias("__digest"), F.col("best.n").alias("__n"))
    kept = written(kept, "kept")
    packed = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__i"), jaccard.digest(text_col).alias("__d"))
    same = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest"))
    one, several = (packed.join(kept.where(n), same) for n in ("__n = 1", "__n > 1"))
    return one.select("__row.*").unionAll(several.dropDuplicates(["__id", "__digest"]).select("__row.*"))


def _named(placed: DataFrame, node: str) -> DataFrame:
    """(node, component_id): the smallest id of its component for each node of ``placed(node, first, component)``."""
    # written, so that Spark sees a plain exchange on both sides of the join and can split a large component
    names = written(placed.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    return written(placed.join(names, "component").select(node, "component_id"), "named")
