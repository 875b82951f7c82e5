"""Embedding near-dedup: robust-pruned graphs of overlapping cluster shards, searched by range."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, hash_sample, slices, written

THRESHOLD = 0.98
#: Vectors that the centroids are fitted on: so many, or beyond that one in SAMPLED_ONE_IN, but not more
#: than SAMPLE_MOST. Rows of a block, and shards that each vector is put in at least and at most.
SAMPLE = 20_000
SAMPLED_ONE_IN = 64
SAMPLE_MOST = 60_000
BLOCK_ROWS = 2_048
OVERLAP, OVERLAP_MOST = 2, 8
#: A vector is also put in the shards of all centroids that are farther by this at most than its nearest.
SLACK = 0.08
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 32
#: Edges of each vector to others drawn at random, which lead into and out of dense groups.
LONG = 6
#: The audit asks for every row whose id this divides, and compares blocks of so many rows; if none of them has links,
#: for so many drawn by a hash (all of a smaller table). Under that recall the search is made again, wider.
AUDIT_EVERY = 100
AUDIT_ROWS = 16_384
AUDIT_DRAWN = 8_192
MIN_RECALL = 0.98

_log = logging.getLogger(__name__)


def unit_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, unit, key): components of length 1 in double precision, and their digest.

    unit is null for vectors that link with nothing: null, empty or zero ones, those that hold a
    null or a number that isn't finite, and those without a label. Vectors of another length are
    of another label. Components are scaled by the largest first, so that squares of very large
    or small ones neither overflow nor vanish.
    """
    inf = float("inf")
    v = F.col(vector_col).cast("array<double>")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("l"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.col("l").isNotNull()
    out = out.withColumn("v", F.when(fine, F.col("v")))
    out = out.withColumn("top", F.array_max(F.transform("v", F.abs)))
    out = out.withColumn("v", F.when(F.col("top") > 0, F.transform("v", lambda x: x / F.col("top"))))
    out = out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    out = out.withColumn("unit", F.transform("v", lambda x: x / F.col("norm")))
    key = F.sha2(F.array_join(F.col("unit").cast("array<string>"), ","), 256)
    return out.select("vec_id", F.concat_ws(":", F.size("v"), "l").alias("label"), "unit", key.alias("key"))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over a bounded sample."""
    rng = np.random.default_rng(3)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def robust_prune(u: np.ndarray) -> tuple[np.ndarray, int]:
    """Neighbours of each vector of a block, padded with -1, and the medoid.

    Of the nearest candidates the nearest is kept and those that lie ALPHA times nearer to it
    than to the vector go, again and again. Some long edges are drawn. Edges lead back as well.
    """
    n = len(u)
    d = np.maximum(2 - 2 * (u @ u.T), 0)
    medoid = int(d.sum(axis=1).argmin())
    if n == 1:
        return np.full((1, 1), -1), medoid
    np.fill_diagonal(d, np.inf)
    most = min(CANDIDATES, n - 1)
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    to = np.take_along_axis(d, near, 1)
    alive, rows = np.ones(near.shape, bool), np.arange(n)
    edges = np.zeros((n, n), bool)
    for _ in range(DEGREE):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        best = near[rows, pick]
        edges[rows[some], best[some]] = True
        alive &= ALPHA * d[best[:, None], near] > to
        alive[rows, pick] = False
    edges[np.repeat(rows, LONG), np.random.default_rng(n).integers(0, n, n * LONG)] = True
    edges |= edges.T
    np.fill_diagonal(edges, False)
    width = int(edges.sum(axis=1).max())
    out = np.full((n, width), -1)
    i, j = np.nonzero(edges)
    at = np.arange(i.size) - np.searchsorted(i, i)
    out[i, at] = j
    return out, medoid


def range_search(
    queries: np.ndarray, u: np.ndarray, near: np.ndarray, starts: np.ndarray, threshold: float, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector of the graph) within the threshold.

    ``starts`` has each query's places to start from, padded with -1: medoids, its own place if it
    is in the graph, and its neighbours in the united lists. It walks greedily from them, expanding
    the nearest vector in its beam that it hasn't yet; then all vectors in range are expanded until
    no new ones turn up. Similarities are exact, in double precision.
    """
    n, rows = len(u), np.arange(len(queries))
    seen, done, hit = (np.zeros((len(queries), n), bool) for _ in range(3))

    def look(q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of the vectors w of each query of q (rows of padded lists); -inf for those seen before."""
        score = np.full(w.shape, -np.inf)
        new = (w >= 0) & ~seen[q[:, None], w]
        i, j = np.nonzero(new)
        if i.size:
            # of a vector that a row has twice one counts
            _, first = np.unique(q[i].astype(np.int64) * n + w[i, j], return_index=True)
            i, j = i[first], j[first]
            for at in range(0, i.size, 1 << 15):
                a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                score[a, b] = np.einsum("ij,ij->i", queries[q[a]], u[w[a, b]])
            seen[q[i], w[i, j]] = True
            hit[q[i], w[i, j]] = score[i, j] >= threshold
        return score

    pool, value = starts, look(rows, starts)
    for _ in range(min(beam, n)):
        open_ = np.where((pool >= 0) & ~done[rows[:, None], pool], value, -np.inf)
        best = open_.argmax(axis=1)
        live = np.flatnonzero(open_[rows, best] > -np.inf)
        if not live.size:
            break
        at = pool[live, best[live]]
        done[live, at] = True
        w = np.full((len(queries), near.shape[1]), -1)
        w[live] = near[at]
        score = np.full(w.shape, -np.inf)
        score[live] = look(live, near[at])
        pool, value = np.hstack([pool, w]), np.hstack([value, score])
        if pool.shape[1] > beam:
            top = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
            pool, value = np.take_along_axis(pool, top, 1), np.take_along_axis(value, top, 1)
    while True:
        q, v = np.nonzero(hit & ~done)
        if not q.size:
            return np.nonzero(hit)
        done[q, v] = True
        for at in range(0, q.size, 1 << 13):
            look(q[at : at + (1 << 13)], near[v[at : at + (1 << 13)]])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _place(nodes: DataFrame, overlap: int, slack: float) -> DataFrame:
    """Put each node in the shards of its nearest centroids, and in one block of each of them.

    Two near vectors differ little in their distance to any centroid, so that of a pair that
    a boundary parts both lie near to it, and the slack puts both on either side.
    """
    spark = nodes.sparkSession
    rows = nodes.count()

    def pack(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in _rows(b.column(1))], pa.binary())], ["label", "unit"])

    sample = hash_sample(nodes, min(max(SAMPLE, rows // SAMPLED_ONE_IN), SAMPLE_MOST), "node").select("label", "unit")
    by: dict[str, list] = {}
    for r in sample.mapInArrow(pack, "label string, unit binary").toLocalIterator():
        by.setdefault(r["label"], []).append(np.frombuffer(r["unit"]))
    share = max(rows, 1) / max(sum(map(len, by.values())), 1)
    # labels that the sample lacks, or too few of for several centroids, are one shard each
    tables = {}
    for label, units in by.items():
        k = min(len(units) // 8, -(-int(len(units) * share) * 4 // BLOCK_ROWS))
        if k > 1:
            tables[label] = fit_centroids(np.array(units), k)
    shared = spark.sparkContext.broadcast(tables)

    def assign(it):
        for b in slices(it, rows=2_000):
            labels, shards = np.array(b.column("label").to_pylist(), object), [[0]] * b.num_rows
            for label, c in shared.value.items():
                at = np.flatnonzero(labels == label)
                if not at.size:
                    continue
                d = np.sqrt(np.maximum(2 - 2 * (np.vstack(_rows(b.column("unit").take(pa.array(at)))) @ c.T), 0))
                most = min(max(OVERLAP_MOST, overlap), len(c))
                some = np.argpartition(d, most - 1, axis=1)[:, :most]
                some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
                far = np.take_along_axis(d, some, 1)
                keep = (np.arange(most) < overlap) | (far <= far[:, :1] + slack)
                for row, s, k in zip(at.tolist(), some, keep):
                    shards[row] = np.sort(s[k]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int32()))], [*b.schema.names, "shards"])

    put = nodes.mapInArrow(assign, "label string, node long, copies long, unit array<double>, shards array<int>")
    put = written(put.withColumn("shard", F.explode("shards")), "placed")
    sizes = put.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("k"))
    own = F.pmod(F.xxhash64(F.lit(31), "node"), F.col("k")).cast("int")
    return put.join(sizes, ["label", "shard"]).withColumn("own", own)


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in column.to_numpy(zero_copy_only=False)]


def _starts(ids: np.ndarray, lists: list[list[int]], asking: np.ndarray, entries: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Places of each query to start from in a graph of ``ids``: entries, its own, and those of its united list."""
    found = []
    for r, k in enumerate(asking.tolist()):
        at = np.minimum(np.searchsorted(ids, lists[k]), ids.size - 1) if lists[k] else np.zeros(0, np.int64)
        mine = at[ids[at] == lists[k]] if at.size else at
        found.append([*entries.tolist(), *([] if own is None else [int(own[r])]), *mine.tolist()])
    out = np.full((len(found), max(map(len, found), default=1)), -1)
    for row, some in zip(out, found):
        row[: len(some)] = some
    return out


def _mix(node: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each node's number, as signed ones."""
    x = node.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _homes(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shard that each pair shares, and its shared shards, padded with -1."""
    x, y = shards[a], shards[b]
    both = np.where((x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0), x, -1)
    return np.where(both >= 0, both, np.iinfo(np.int64).max).min(axis=1), both


def _account(a: np.ndarray, mark: np.ndarray, home: np.ndarray, both: np.ndarray, shard: int) -> np.ndarray:
    """(place, home, via, n, mark) of pairs that this shard found and another shares.

    A home counts them down for each of the other shards, those count them up for the home, so that
    sums of n, and exclusive ors of the marks of pairs, are zero where both found the same ones.
    """
    own = home == shard
    i, k = np.nonzero(own[:, None] & (both >= 0) & (both != shard))
    j = np.flatnonzero(~own)
    rows = np.stack([np.concatenate([a[i], a[j]]), np.concatenate([home[i], home[j]]), np.concatenate([both[i, k], np.full(j.size, shard)])], axis=1)
    keys, at = np.unique(rows, axis=0, return_inverse=True)
    n, marks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    np.add.at(n, at.ravel(), np.concatenate([np.full(i.size, -1), np.ones(j.size, np.int64)]))
    np.bitwise_xor.at(marks, at.ravel(), np.concatenate([mark[i], mark[j]]))
    return np.column_stack([keys, n, marks])


def _links(nodes: DataFrame, threshold: float, overlap: int, slack: float, beam: int) -> DataFrame:
    """(node, links, root) of nodes with links: so many vectors, and a node that they lead to.

    A pair is counted in the first shard that it shares, its home. Shards tell no pairs, but the
    number and a digest of those of each node that they share with another. Where two don't agree,
    both tell theirs, and what the home missed is counted as well, so that no pair is lost that any
    search found.
    """
    placed = _place(nodes, overlap, slack)
    names = ["label", "shard", "k", "own", "node", "copies", "unit", "shards"]

    def build(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        near, medoid = robust_prune(_matrix(t.column("unit")))
        lists = [node[r[r >= 0]].tolist() for r in near]
        flags = np.arange(len(node)) == medoid
        return pa.table([*[t.column(c) for c in names], pa.array(lists, pa.list_(pa.int64())), pa.array(flags)], [*names, "near", "medoid"])

    schema = "label string, shard int, k int, own int, node long, copies long, unit array<double>, shards array<int>"
    built = placed.select(*names).groupBy("label", "shard", "own").applyInArrow(build, f"{schema}, near array<long>, medoid boolean")
    built = written(built, "graph")
    # a node is in a bounded number of shards, and so are its lists; sorted, so that a search made again takes the same way
    union = built.groupBy("node").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    dealt = built.drop("near").join(union, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.select("label", "shard", "i", "j", "own", "node", "copies", "unit", "shards", "near", "medoid")

    def pairs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        u = _matrix(t.column("unit"))
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        medoid = t.column("medoid").to_numpy(zero_copy_only=False)
        lists = t.column("near").to_pylist()
        found = []
        # within a block each vector looks for others; of two blocks each asks the other's graph
        for block in np.unique(own):
            inside = np.flatnonzero(own == block)
            asking = np.flatnonzero(own != block) if cross else inside
            if not asking.size:
                continue
            ids = node[inside]
            near = _starts(ids, lists, inside, np.zeros(0, np.int64), None)
            starts = _starts(ids, lists, asking, np.flatnonzero(medoid[inside]), None if cross else np.arange(inside.size))
            if not near.shape[1]:
                near = np.full((inside.size, 1), -1)
            q, v = range_search(u[asking], u[inside], near, starts, threshold, beam)
            found.append((asking[q], inside[v]))
        q, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        q, v = q[q != v], v[q != v]
        # found from either end
        return np.divmod(np.unique(np.minimum(q, v) * len(node) + np.maximum(q, v)), len(node))

    def shared(t: pa.Table, a: np.ndarray, b: np.ndarray):
        """(slice of the pairs, homes, shared shards), a bounded number of pairs at a time."""
        lists = t.column("shards").to_pylist()
        width = max(map(len, lists))
        s = np.array([x + [-1] * (width - len(x)) for x in lists])
        for at in range(0, a.size, 1 << 17):
            some = slice(at, at + (1 << 17))
            yield some, *_homes(s, a[some], b[some])

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, copies, shard = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("shard")[0].as_py()
        a, b = pairs_of(t)
        first, told = np.zeros(a.size, bool), [np.zeros((0, 5), np.int64)]
        for some, home, both in shared(t, a, b):
            first[some] = home == shard
            told.append(_account(a[some], _mix(node[b[some]]), home, both, shard))
        told = np.concatenate(told)
        links, none = _counted(node, copies, a[first], b[first]), pa.nulls(len(told), pa.int64())
        told = pa.table([pa.array(node[told[:, 0]]), none, none, *(pa.array(told[:, i]) for i in range(1, 5))], FOUND)
        return pa.concat_tables([pa.table([*links.columns, *(pa.nulls(len(links), pa.int64()) for _ in range(4))], FOUND), told])

    def tell(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, copies, shard = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("shard")[0].as_py()
        a, b = pairs_of(t)
        again = t.column("again").to_pylist()
        keep, own = np.zeros(a.size, bool), np.zeros(a.size, bool)
        for some, home, _ in shared(t, a, b):
            own[some] = home == shard
            keep[some] = [h in (again[p] or ()) for p, h in zip(a[some].tolist(), home.tolist())]
        a, b, own = a[keep], b[keep], own[keep]
        return pa.table({"a": node[a], "b": node[b], "more_a": copies[b], "more_b": copies[a], "counted": own})

    by = ["label", "shard", "i", "j"]
    found = written(dealt.groupBy(*by).applyInArrow(search, ", ".join(f"{c} long" for c in FOUND)), "found")
    links = found.where("home IS NULL").select("node", "links", "root")
    odd = found.where("home IS NOT NULL").groupBy("node", "home", "via").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))
    odd = written(odd.where("n <> 0 OR mark <> 0"), "odd")
    if odd.isEmpty():
        return links
    again = odd.groupBy("node").agg(F.collect_set("home").alias("again"))
    at = odd.select("node", F.explode(F.array("home", "via")).alias("shard")).distinct()
    groups = dealt.select(*by, "node").join(at, ["node", "shard"]).select(*by).distinct()
    told = dealt.join(groups, by, "left_semi").join(again, "node", "left").groupBy(*by)
    told = told.applyInArrow(tell, "a long, b long, more_a long, more_b long, counted boolean").groupBy("a", "b")
    lost = told.agg(F.max("counted").alias("counted"), F.max("more_a").alias("more_a"), F.max("more_b").alias("more_b")).where("NOT counted")
    ends = [F.struct(F.col(c).alias("node"), F.col(f"more_{c}").alias("links")) for c in ("a", "b")]
    lost = lost.select("a", F.explode(F.array(*ends)).alias("x"))
    return links.unionAll(lost.select("x.node", "x.links", F.col("a").alias("root")))


#: Columns of what a search of two blocks gives: links, or its account of pairs that other shards share.
FOUND = ["node", "links", "root", "home", "via", "n", "mark"]
LINKS = "node long, links long, root long"


def _counted(node: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Links of each node that has some by pairs of places, and the first node that they join it with."""
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = np.arange(len(node))
    while a.size:
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    some = np.flatnonzero(links)
    return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """What ``_links`` gives, by comparing all blocks of a label: the exact way if the graph's recall is too low."""
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("k"))
    dealt = nodes.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64(F.lit(31), "node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "unit")

    def compare(t: pa.Table) -> pa.Table:
        node, own, copies = (t.column(c).to_numpy() for c in ("node", "own", "copies"))
        u, cross = _matrix(t.column("unit")), t.column("i")[0].as_py() != t.column("j")[0].as_py()
        a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        keep = own[a] != own[b] if cross else np.ones(a.size, bool)
        return _counted(node, copies, a[keep], b[keep])

    return dealt.groupBy("label", "i", "j").applyInArrow(compare, LINKS)


def _audit(nodes: DataFrame, threshold: float, asked: str) -> DataFrame:
    """(node, audited): the links of the nodes that are asked for, by comparing them with every vector of their label.

    Questions and vectors are dealt to blocks of bounded size, and each pair of blocks is a task's.
    """

    def dealt(side: DataFrame, k: str, k_other: str, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(37), "node"), F.col(k)).cast("int")
        out = side.join(sizes, "label").withColumn(own, place)
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(k_other) - 1)))
        # columns of their own, as both sides are of one table
        return out.select(*[F.col(c).alias(c) for c in ("label", "p", "b", "node", "copies", "unit")])

    asks = F.count(F.when(F.expr(asked), 1))
    blocks = lambda n: F.ceil(n / AUDIT_ROWS).cast("int")
    sizes = nodes.groupBy("label").agg(blocks(F.count("*")).alias("kb"), blocks(asks).alias("kp")).where("kp > 0")
    questions, vectors = dealt(nodes.where(asked), "kp", "kb", "p", "b"), dealt(nodes, "kb", "kp", "b", "p")

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        total = np.zeros(len(q), np.int64)
        if len(q) and len(v):
            x, u = _matrix(q.column("unit")), _matrix(v.column("unit"))
            ids, node, copies = q.column("node").to_numpy(), v.column("node").to_numpy(), v.column("copies").to_numpy()
            for at in range(0, len(q), 256):
                hit = (x[at : at + 256] @ u.T >= threshold) & (ids[at : at + 256, None] != node)
                total[at : at + 256] = hit @ copies
        return pa.table({"node": q.column("node"), "n": total})

    by = ["label", "p", "b"]
    told = questions.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInArrow(compare, "node long, n long")
    return written(told.groupBy("node").agg(F.sum("n").alias("audited")), "audit")


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    overlap: int = OVERLAP,
    slack: float = SLACK,
    beam: int = BEAM,
    min_recall: float = MIN_RECALL,
) -> DataFrame:
    """Links within the cosine threshold between vectors of one label: one row per vector.

    vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable),
    kept, and audited_links, what comparing with every vector gives for each row whose id is
    divisible by AUDIT_EVERY, else null. Equal vectors are one node with a number of copies. Graphs
    are built in blocks of cluster shards, their lists are united by node, and each pair of a
    shard's blocks is searched in a task, along the united lists as far as they lie in it, so that
    no shard, however large, meets in one. Recall is the mean over audited vectors with links of
    the share that was found. If it is below ``min_recall``, shards overlap more and the search is
    wider; if that doesn't help either, all blocks of each label are compared. If no vector asked
    for has links, recall is taken from AUDIT_DRAWN others, which are all of a small table; if none
    of those has any either, the first search stands. The recall is logged.

    What links with nothing (see unit_vectors) gets 0 links and itself as component. Rows that
    share an id are vectors of their own, each with its own links and component; a null id links
    with nothing. An empty table gives an empty result; other columns are not looked at.
    """
    rows = written(unit_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col), "vectors")
    nodes = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("unit").alias("unit"),
        F.max(F.pmod("vec_id", F.lit(AUDIT_EVERY)) == 0).alias("asked"),
    )
    # numbers of their own, as different vectors may share an id
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bare = nodes.select("label", "node", "copies", "unit")
    audit = _audit(nodes, threshold, "asked")
    linked = audit.where("audited > 0")
    if linked.isEmpty():
        drawn = hash_sample(nodes, AUDIT_DRAWN, "node", seed=41)
        marked = nodes.join(drawn.select("node", F.lit(True).alias("drawn")), "node", "left")
        linked = _audit(marked, threshold, "drawn").where("audited > 0")
    for attempt in range(3):
        found = _links(bare, threshold, overlap + 2 * attempt, slack * 2**attempt, beam * 2**attempt) if attempt < 2 else _all_links(bare, threshold)
        links = written(found, "links")
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        told = linked.join(counts, "node", "left")
        recall = told.agg(F.avg(F.least(F.coalesce("links", F.lit(0)) / F.col("audited"), F.lit(1.0)))).first()[0]
        _log.info("search %d of embeddings: recall %s", attempt + 1, recall)
        if recall is None or recall >= min_recall:
            break
    group = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("label", "key", "node", "first", "copies").join(counts, "node", "left").join(group, "node", "left").join(audit, "node", "left")
    placed = written(placed.withColumn("component", F.coalesce("component", "node")), "placed-nodes")
    names = written(placed.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    placed = placed.join(names, "component").select(
        F.col("label").alias("__label"),
        F.col("key").alias("__key"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
        (F.col("audited") + F.col("copies") - 1).alias("audited_links"),
    )
    same = (F.col("label") == F.col("__label")) & (F.col("key") == F.col("__key")) & F.col("vec_id").isNotNull()
    asked = F.col("vec_id") % AUDIT_EVERY == 0
    return rows.join(placed, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
        F.when(asked, F.col("audited_links")).alias("audited_links"),
    )
