"""Sets of word shingles: their exact check at a Jaccard similarity of 0.8, and the pairs that fingerprints miss.

At a similarity of 0.8 some nine of 64 SimHash bits differ, and up to twice that, which is so near to
the distance of unrelated texts that no tree over fingerprints parts them. ``simhash.similar`` links
what lies within its radius and takes from here the exact way for the rest: prefixes of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import given_back, hash_sample, small_batches, written
from tidewatch.llm.common import slices as _slices

WORDS = 5
SEED = 42
#: Sets that shingles are counted in at most, and frequent shingles that are broadcast at most.
ORDER_SAMPLE = 10_000
FREQUENT = 100_000
#: Prefix rows that a bucket stands for, about, and rows of one shingle that a task compares at once.
BUCKET_ROWS = 250_000
BLOCK_ROWS = 20_000
#: Sets with a shingle, by the sample's telling, beyond which it is dealt over all buckets.
HOT_ROWS = 100_000
#: Bits of a set's parity sketch in a bucket; a wide one has twice as many bits as elements, as a power of two up to WIDE_MOST.
SKETCH_BITS = 512
WIDE_MOST = 1 << 16
#: Buckets of so many rows at most are compared all at once.
SMALL_BUCKET = 16
#: Words of 64 bits in the filter that leaves out texts that are in no pair.
FILTER_WORDS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    return given_back(_slices(batches, rows, size))


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of a whole text's shingles in order.

    A-Z are lower-cased, ASCII white space separates words. A text of fewer words is one shingle,
    one without words or null has none.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode(errors="surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.array([xxh64_intdigest(joined[a:z], seed) for a, z in spans], "<u8"))


def digest(text_col: str) -> Column:
    """The MD5 of a text; the empty string for null."""
    return F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))


def set_print(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, found.size, 1 << 16):
        part = found[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > found.size, bitorder="little").view("<u8")[0])


def parity(found: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """For each of so many cells, a power of two, whether an odd number of the set's hashes fall into it.

    The sketches of two sets differ in as many bits at most as the sets have elements not in common.
    """
    cells = (found * _MIX >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1).tobytes()


def wide_parity(found: np.ndarray) -> bytes:
    return parity(found, min(max(SKETCH_BITS, 1 << (2 * found.size).bit_length()), WIDE_MOST))


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded, as cells are numbered by their last bits."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    n = min(x.size, y.size)
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def signatures(
    docs: DataFrame, often: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, digest, node, n, fp, sketch, wide, prefix) of every row; equal sets have the same node, equal texts the same digest.

    The prefix holds the rarest shingles of the set, of which two sets of similarity 0.8 share one:
    they are ordered by their count in a bounded sample, then by value. The order only decides how
    many sets meet; with any, a set of n that shares four fifths of it misses n - ceil(0.8 n) at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often[:2])

    def run(it):
        from xxhash import xxh3_64_intdigest

        token, count = shared.value
        for b in slices(it):
            made = []
            for text in b.column(0).to_pylist():
                s = shingles(text)
                most = s.size - (4 * s.size + 4) // 5 + 1 if s.size else 0
                p = s[:most]
                if token.size and s.size:
                    at = np.minimum(np.searchsorted(token, s), token.size - 1)
                    c = np.where(token[at] == s, count[at], 0)
                    if c.any():
                        p = s[np.argsort(c, kind="stable")[:most]]
                node = np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64)
                made.append((int(node), s.size, int(np.uint64(set_print(s)).astype(np.int64)), parity(s), wide_parity(s), p.tobytes()))
            cols = zip(*made) if made else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(2), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "digest", "node", "n", "fp", "sketch", "wide", "prefix"],
            )

    texts = docs.select(F.col(text_col).cast("string").alias("text"), digest(text_col).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
    return texts.mapInArrow(run, "doc_id long, digest string, node long, n int, fp long, sketch binary, wide binary, prefix binary")


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent shingles in order with their counts in a bounded sample of the texts, and the share that this is."""

    def run(it):
        for b in slices(it):
            found = [np.zeros(0, "<u8"), *map(shingles, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("<i8"))], ["shingle"])

    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    rows = texts.count()
    drawn = hash_sample(texts, ORDER_SAMPLE, "text")
    found = drawn.mapInArrow(run, "shingle long")
    found = found.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    got = found.collect()
    token = np.array([r.shingle for r in got], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r.n for r in got], np.int64)[order], max(1.0, rows / ORDER_SAMPLE)


def packed_prefixes(signs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(b, blob): columns of shingles, nodes, sizes and places in the prefix, packed by bucket.

    A ``hot`` shingle, which very many sets have, is dealt over all buckets, below 0: that several
    sets have it needs no telling.
    """

    def run(it):
        done: set[int] = set()
        for batch in slices(it, rows=4000):
            new = []
            for node, n, prefix in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix and node not in done:
                    done.add(node)
                    new.append((node, n, np.frombuffer(prefix, "<u8")))
            if not new:
                continue
            k = np.array([p.size for _, _, p in new])
            tokens, own = np.concatenate([p for _, _, p in new]), np.repeat(np.arange(k.size), k)
            node = np.array([x for x, _, _ in new], np.int64)[own]
            where = ((tokens * _MIX) >> np.uint64(33)).astype(np.int64) % buckets
            # within a bucket half of a shingle's bits tell it well enough: others cost a comparison, none is lost
            short = tokens.astype("<u4")
            if hot.size:
                very = np.isin(tokens, hot)
                where[very] = -1 - ((tokens[very] ^ node[very].view(np.uint64)) * _MIX >> np.uint64(33)).astype(np.int64) % buckets
                short[very] = np.searchsorted(hot, tokens[very])
            at = np.minimum(np.arange(own.size) - (np.cumsum(k) - k)[own], 0xFFFF).astype("<u2")
            cols = short, node, np.array([n for _, n, _ in new], np.int32)[own], at
            order = np.argsort(where, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(where[order], prepend=where[order[0]] - 1)), order.size)
            parts = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
            blobs = [b"".join(c[p].tobytes() for c in cols) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(where[p[0]]) for p in parts], pa.int32()), pa.array(blobs, pa.binary())], ["b", "blob"])

    return signs.select("node", "n", "prefix").mapInArrow(run, "b int, blob binary")


def shared_rows(signs: DataFrame, total: int, often: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(shingle, node, n, at, k) of the prefixes whose shingle several sets have; k blocks hold a shingle's rows.

    ``total`` is the number of prefix rows, ``often`` what ``frequent`` gives.
    """
    token, count, times = often
    everywhere = (count * times).astype(np.int64)
    hot, rows_of = token[everywhere > HOT_ROWS], everywhere[everywhere > HOT_ROWS]

    def run(t: pa.Table) -> pa.Table:
        blobs, b = t.column("blob").to_pylist(), t.column("b")[0].as_py()
        m = [len(x) // 18 for x in blobs]
        kinds = ("<u4", 0), ("<i8", 4), ("<i4", 12), ("<u2", 16)
        token, node, n, at = (np.concatenate([np.frombuffer(x, kind, k, place * k) for x, k in zip(blobs, m)]) for kind, place in kinds)
        order = np.lexsort((node, token))
        order = order[np.append(True, (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1]))]
        token = token[order]
        heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(heads, token.size))
        # below 0 there is a share of the rows of each shingle
        blocks = -(-(sizes if b >= 0 else rows_of[token[heads]]) // BLOCK_ROWS)
        keep = np.repeat((sizes > 1) | (b < 0), sizes)
        k = np.repeat(blocks, sizes)[keep].astype(np.int32)
        # a bucket's shingles apart from those of others, and very frequent ones the same in all
        shingle = token[keep].astype(np.int64) + ((b + 1 << 32) if b >= 0 else 0)
        cols = [shingle, node[order][keep], n[order][keep], at[order][keep].astype(np.int32), k]
        return pa.table(list(map(pa.array, cols)), ["shingle", "node", "n", "at", "k"])

    packed = packed_prefixes(signs, max(1, total // BUCKET_ROWS), hot)
    return packed.groupBy("b").applyInArrow(run, "shingle long, node long, n int, at int, k int")


def whole_buckets(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, joined and cut so that no bucket, told by the first column, is parted."""
    held: list[list[np.ndarray]] = []
    for b in it:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        held.append(cols)
        if cols[0][-1] == held[0][0][0]:
            continue
        joined = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.flatnonzero(joined[0] != joined[0][-1])[-1]) + 1
        yield [c[:cut] for c in joined]
        held = [[c[cut:] for c in joined]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def may_link(n: np.ndarray, at: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets that meet at a shingle, the first they share, can share enough for 0.8.

    Sets of that similarity differ in a ninth of their elements together at most, and so do their sketches.
    """
    both = n[i].astype(np.int64) + n[j]
    may = 9 * np.minimum(n[i] - at[i], n[j] - at[j]).astype(np.int64) >= 4 * both
    may[may] = 9 * np.bitwise_count(sketch[i[may]] ^ sketch[j[may]]).sum(axis=1, dtype=np.int64) <= both[may]
    return may


def candidates(shared: DataFrame, nodes: DataFrame, group: DataFrame, *, every: bool) -> DataFrame:
    """Pairs (a, b) of sets of different groups that a bucket allows: all, or those that span what all would join.

    ``nodes`` has the sketches, ``group`` the components so far. The rows of a shingle that very many
    sets have are dealt into blocks, and two blocks of them meet in a task.
    """
    told = nodes.select("node", "sketch").join(group, "node", "left").select(F.col("node").alias("__n"), "sketch", F.coalesce("component", "node").alias("component"))
    own = F.pmod(F.xxhash64(F.lit(29), "node"), F.col("k")).cast("int")
    rows = shared.join(told, F.col("node") == F.col("__n")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    cross = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).cast("int")
    rows = rows.withColumn("key", F.when(F.col("k") > 1, pair).otherwise(F.col("shingle"))).withColumn("own", cross)
    rows = rows.repartition("key").sortWithinPartitions("key", "n", "node").select("key", "node", "n", "at", "component", "own", "sketch")

    def large(n, at, component, own, sketch, a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # sets in order of size: a set's partners end where they are a quarter larger
        ends = np.searchsorted(4 * n[a:z].astype(np.int64), 5 * n[a:z].astype(np.int64), "right") + a
        for i in range(a, z - 1):
            j = np.arange(i + 1, ends[i - a])
            j = j[(component[j] != component[i]) & ((own[i] < 0) | (own[j] != own[i]))]
            if j.size:
                mine = np.full(j.size, i)
                keep = may_link(n, at, sketch, mine, j)
                yield mine[keep], j[keep]

    def pairs(key, n, at, component, own, sketch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, key.size))
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        for lag in range(1, min(SMALL_BUCKET, key.size)):
            i = np.flatnonzero(small[:-lag] & (key[lag:] == key[:-lag]))
            if not i.size:
                break
            j = i + lag
            keep = (component[i] != component[j]) & ((own[i] < 0) | (own[i] != own[j])) & (4 * n[j].astype(np.int64) <= 5 * n[i].astype(np.int64))
            i, j = i[keep], j[keep]
            keep = may_link(n, at, sketch, i, j)
            yield i[keep], j[keep]
        for a, z in zip(heads[sizes > SMALL_BUCKET].tolist(), (heads + sizes)[sizes > SMALL_BUCKET].tolist()):
            if (component[a:z] != component[a]).any():
                yield from large(n, at, component, own, sketch, a, z)

    def run(it):
        for key, node, n, at, component, own, raw in given_back(whole_buckets(it)):
            sketch = np.frombuffer(b"".join(raw), "<u8").reshape(key.size, -1)
            names, first, place = np.unique(node, return_index=True, return_inverse=True)
            found = ((place[i], place[j]) for i, j in pairs(key, n, at, component, own, sketch))
            if every:
                both = [np.zeros((2, 0), np.int64), *map(np.array, found)]
                i, j = np.concatenate(both, axis=1)
            else:
                i, j = spanning(names.size, found, start=component[first])
            x, y = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: x.size]
            yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs over n items that make a spanning forest of what they join.

    ``start`` has a name for each item; items of one name are joined from the start. Each root hooks
    on to a smaller one by a pair drawn by a hash, so that no item of a large group gets very many
    of the pairs and no long chain comes of it.
    """
    root = np.arange(n)
    if start is not None:
        _, at, place = np.unique(start, return_index=True, return_inverse=True)
        root = at[place]
    kept: list[tuple[np.ndarray, np.ndarray]] = [(root[:0], root[:0])]
    for i, j in pairs:
        while i.size:
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not i.size:
                break
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            draw = (lo.astype(np.uint64) * _MIX) ^ (hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            best = np.zeros(n, np.uint64)
            np.maximum.at(best, hi, (draw >> np.uint64(32) << np.uint64(32)) | np.arange(i.size, dtype=np.uint64))
            hooked = np.unique(hi)
            pick = (best[hooked] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            root[hooked] = lo[pick]
            kept.append((i[pick], j[pick]))
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted(node, digest)``, made from the texts again.

    A filter of fixed size leaves out most other texts, so that only few are looked at and shuffled.
    """
    spot = F.pmod(F.xxhash64("digest"), F.lit(64 * FILTER_WORDS))
    bits = wanted.select(spot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    held = np.zeros(FILTER_WORDS, np.int64)
    for w, b in bits.collect():
        held[w] = b
    shared = docs.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def run(it):
        done: set[str] = set()
        for b in given_back(it):
            s = b.column(2).to_numpy()
            for part in _slices([b.filter(pa.array((shared.value[s // 64] >> (s % 64).astype(np.uint64) & np.uint64(1)).astype(bool)))]):
                new = [(d, t) for t, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if not (d in done or done.add(d))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in new], pa.string()), pa.array([shingles(t).tobytes() for _, t in new], pa.binary())], ["digest", "shingles"]
                )

    texts = docs.select(F.col(text_col).cast("string").alias("text"), digest(text_col).alias("digest")).withColumn("s", spot)
    made = texts.mapInArrow(run, "digest string, shingles binary").join(wanted, "digest")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 or more, by all their shingles.

    Wide sketches leave out first what can't have it, so that few sets are made again and sent.
    """

    def may(it):
        for b in given_back(it):
            n, m = (b.column(k).to_numpy() for k in (2, 4))
            apart = [sketches_differ(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist())]
            yield b.filter(pa.array(9 * np.array(apart, np.int64) <= n.astype(np.int64) + m)).select(["a", "b"])

    told = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("wide").alias("x")), "a")
    told = told.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")), "b")
    pairs = written(told.select("a", "b", "n", "x", "m", "y").mapInArrow(may, "a long, b long"), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest"), "node")
    sets = written(_sets(docs, written(named, "named"), text_col), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(it):
        for b in slices(it):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(9 * np.intersect1d(x, y, assume_unique=True).size >= 4 * (x.size + y.size))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return written(both.mapInArrow(run, "a long, b long"), "links")
