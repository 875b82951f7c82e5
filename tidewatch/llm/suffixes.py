"""Repeated substrings across documents: sampled windows, shards of suffixes, deep-shallow sorting."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import give_back, slices, small_batches, unused, written

#: A window of this many bytes counts as repeated; each is filed under its smallest 16-gram hash.
WINDOW = 50
GRAM = 16
#: Bytes of text that a group of documents and a bucket of windows stand for, about.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: Windows of a run at most, and bytes that the shallow sort looks at.
RUN = 64
SHALLOW = 24
#: Parts into which the rows of one text's digest are dealt.
SALTS = 8
#: Bytes of a SHA-256 that tell a copy.
DIGEST = 16
#: Windows hashed at once, and bytes of documents that are hashed together; both fit a core's cache.
_SLICE = 1 << 15
_TOGETHER = 1 << 18
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def window_keys(raw: bytes) -> np.ndarray:
    """For each window of the bytes the least hash of its 16-grams; equal windows have equal keys."""
    out = []
    for at in range(0, max(0, len(raw) - WINDOW + 1), _SLICE):
        x = np.frombuffer(raw[at : at + _SLICE + WINDOW - 1], np.uint8)
        h = x.astype(np.uint64) * _M1
        n = 1
        while n < GRAM:
            h = (h[:-n] * _M2 ^ (h[:-n] >> np.uint64(31))) + h[n:] * _M1
            n *= 2
        h ^= h >> np.uint64(32)
        wide, n = WINDOW - GRAM + 1, 1
        while 2 * n <= wide:
            h = np.minimum(h[:-n], h[n:])
            n *= 2
        out.append(np.minimum(h[: h.size - (wide - n)], h[wide - n :]) if wide > n else h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _runs_together(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    count = np.maximum(size - WINDOW + 1, 0)
    from_, n = np.cumsum(count) - count, int(count.sum())
    if not n:
        yield from ((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in raws)
        return
    keys = window_keys(b"".join(raws))
    if len(raws) > 1:  # without the windows that cross from one document into the next
        keys = keys[np.repeat(np.cumsum(size) - size - from_, count) + np.arange(n)]
    starts = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts[from_[count > 0]] = True
    first = np.flatnonzero(starts)
    last = np.append(first[1:], n) - 1
    pieces = (last - first) // RUN + 1
    last = np.repeat(last, pieces)
    first = np.repeat(first, pieces) + (np.arange(last.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
    last = np.minimum(first + RUN - 1, last)
    z = keys[first] * _M1
    z = (z ^ (z >> np.uint64(29))) * _M2
    z ^= z >> np.uint64(32)
    cuts = np.append(np.searchsorted(first, from_), first.size).tolist()
    for at, a, b in zip(from_.tolist(), cuts, cuts[1:]):
        yield z[a:b], first[a:b] - at, last[a:b] - at


def runs_of(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By text the stretches of windows with one key: their keys, mixed, and first and last windows.

    Short texts are hashed together, which gives what each gives alone.
    """
    batch: list[bytes] = []
    held = 0
    for raw in raws:
        if batch and held + len(raw) > _TOGETHER:
            yield from _runs_together(batch)
            batch, held = [], 0
        batch.append(raw)
        held += len(raw)
    if batch:
        yield from _runs_together(batch)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of equal strings together, in order. Inner nodes know a depth and the bytes that part there.

    A string goes down by these bytes alone; the leaf that it reaches shows its longest common
    prefix with any string of the trie, and so where it branches off.
    """
    root: list = [strings[0], [0]]
    for k, s in enumerate(strings[1:], 1):
        node = root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[0]
        if s == t:
            node[1].append(k)
            continue
        depth = next(i for i, (a, b) in enumerate(zip(s, t)) if a != b)
        up, node = None, root
        while isinstance(node[1], dict) and node[0] < depth:
            up, node = (node, s[node[0]]), node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][s[depth]] = [s, [k]]
            continue
        inner = [depth, {t[depth]: node, s[depth]: [s, [k]]}]
        if up is None:
            root = inner
        else:
            up[0][1][up[1]] = inner

    def walk(node: list) -> Iterator[list[int]]:
        if isinstance(node[1], dict):
            for _, child in sorted(node[1].items()):
                yield from walk(child)
        else:
            yield node[1]

    return list(walk(root))


def deep_shallow(buf: bytes, pos: np.ndarray) -> np.ndarray:
    """Class of each window at ``pos``, equal for equal windows and -1 for windows that differ from all others.

    Multikey quicksort with eight bytes as a character orders the windows to a shallow depth. Of
    the groups that still tie, those whose rest is one string are told by comparing with their
    first; blind tries order the others.
    """
    b = np.frombuffer(buf + b"\0" * 8, np.uint8).astype(np.uint64)
    w = b[:-1] << np.uint64(8) | b[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    w = w[:-4] << np.uint64(32) | w[4:]
    classes = np.full(pos.size, -1, np.int64)
    todo, group = np.arange(pos.size), np.zeros(pos.size, np.int64)
    for at in range(0, SHALLOW, 8):
        char = w[pos[todo] + at]
        order = np.argsort(char)
        if at:  # by group and then by the character's rank
            rank = np.empty(char.size, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], char[order[1:]] != char[order[:-1]])))
            order = np.argsort(group * char.size + rank)
        todo, group, char = todo[order], group[order], char[order]
        new = np.concatenate(([True], (char[1:] != char[:-1]) | (group[1:] != group[:-1])))[: todo.size]
        alone = new & np.append(new[1:], True)[: todo.size]
        group = np.cumsum(new)
        todo, group = todo[~alone], group[~alone]
        if not todo.size:
            return classes
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(heads, todo.size))
    lead = np.repeat(pos[todo[heads]], sizes)
    same = np.ones(todo.size, bool)
    for at in (*range(SHALLOW, WINDOW - 8, 8), WINDOW - 8):
        same &= w[pos[todo] + at] == w[lead + at]
    plain = np.logical_and.reduceat(same, heads)
    classes[todo] = np.repeat(np.arange(heads.size), sizes)
    fresh = heads.size
    # two that differ have nothing left to sort
    classes[todo[np.repeat(~plain & (sizes == 2), sizes)]] = -1
    for g in np.flatnonzero(~plain & (sizes > 2)).tolist():
        members = todo[heads[g] : heads[g] + sizes[g]].tolist()
        for equal in blind_trie([buf[p + SHALLOW : p + WINDOW] for p in pos[members].tolist()]):
            for k in equal:
                classes[members[k]] = fresh if len(equal) > 1 else -1
            fresh += 1
    return classes


class Copies(dict):
    """By id the shortened digests of texts that a document with a smaller id has too."""

    def has(self, d: int, raw: bytes) -> bool:
        return d in self and hashlib.sha256(raw).digest()[:DIGEST] in self[d]


def _rows(t: pa.Table, id_col: str, text_col: str, copies: Copies) -> Iterator[tuple[int, bytes]]:
    """Ids and bytes of the rows to look at: those that aren't copies of an earlier document."""
    for d, text in zip(t.column(id_col).to_pylist(), t.column(text_col).to_pylist()):
        raw = text.encode(errors="surrogatepass")
        if not copies.has(d, raw):
            yield d, raw


def _group_keys(found: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, list]:
    """Distinct keys of a group's documents in order, whether several have it, and each document's runs."""
    each = [(d, raw, *r) for (d, raw), r in zip(found, runs_of([raw for _, raw in found]))]
    if not each:
        return np.zeros(0, np.uint64), np.zeros(0, bool), []
    keys = [np.unique(e[2]) for e in each]
    ids = np.concatenate([np.full(k.size, e[0], np.int64) for k, e in zip(keys, each)])
    keys = np.concatenate(keys)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if not keys.size:
        return keys, np.zeros(0, bool), each
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(first[1:], keys.size) - 1
    return keys[first], ids[first] != ids[last], each


def _copies(notes: pa.Table) -> Copies:
    out = Copies()
    for b, blob in zip(notes.column("b").to_pylist(), notes.column("blob").to_pylist()):
        if b < 0:
            out.setdefault(int.from_bytes(blob[DIGEST:], "big", signed=True), set()).add(blob[:DIGEST])
    return out


def _distinct_runs(each: list, wanted: np.ndarray) -> dict[int, dict[bytes, list]]:
    """By key the contents of its runs, sorted, with where they are: [(number of the document, first window)].

    Answers go by this order, so that it must not depend on that of the documents: blocks of a
    shuffle come in another order each time that a group is looked at on another executor.
    """
    out: dict[int, dict[bytes, list]] = {}
    for k, (_, raw, keys, first, last) in enumerate(each):
        at = np.searchsorted(wanted, keys)
        at[at == wanted.size] = 0
        hit = np.flatnonzero(wanted[at] == keys) if wanted.size else np.zeros(0, np.int64)
        for key, a, z in zip(keys[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
            out.setdefault(key, {}).setdefault(raw[a : z + WINDOW], []).append((k, a))
    return {key: dict(sorted(contents.items())) if len(contents) > 1 else contents for key, contents in out.items()}


def find_repeats(docs: DataFrame, finish, schema: T.StructType, *, id_col: str, text_col: str, group_bytes: int, bucket_bytes: int) -> DataFrame:
    """Run ``finish(group's rows, removed bytes by row)`` where a group of documents lies.

    Documents are dealt into groups by a hash of their id; the same exchange of the texts serves
    three looks at them. First each group sends its distinct keys, shortened, to their buckets,
    which answer with those that several documents have. Then each group sends the contents of
    the runs under such keys, once each; a bucket sorts their windows and answers with the
    smallest id that has each. Last each group marks what that covers. A string that very many
    documents share thus reaches a bucket once from each group, whatever the number of documents.
    Whole copies of an earlier document are told by id and digest and stay out of all this. Rows
    with a null id and texts under 50 bytes lose nothing and go to ``finish`` where they lie.
    """
    small_batches(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    takes_part = F.col(id_col).isNotNull() & (F.octet_length(text) >= WINDOW)
    told = written(
        docs.where(takes_part).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n")),
        "digests",
    )
    total = told.agg(F.sum("n")).first()[0] or 0
    groups, buckets = max(1, -(-total // group_bytes)), max(1, -(-total // bucket_bytes))
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(groups)).cast("int")
    firsts = told.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    # very many documents may be copies of one text
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = told.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(firsts, ["sha", "salt"]).where("id > first")
    group, note = unused("__g", docs.columns), "b int, blob binary"
    noted = F.concat(F.substring("sha", 1, DIGEST), F.unhex(F.lpad(F.hex("id"), 16, "0")))
    copies = written(copies.select("sha", "id").distinct().select(of("id").alias(group), F.lit(-1).alias("b"), noted.alias("blob")), "copies")
    base = docs.where(takes_part).withColumn(group, of(id_col))

    def send_keys(rows: pa.Table, notes: pa.Table) -> pa.Table:
        keys, multi, _ = _group_keys(list(_rows(rows, id_col, text_col, _copies(notes))))
        where = buckets_of(keys, buckets)
        g = rows.column(group)[0].as_py() if rows.num_rows else 0
        made = []
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for part in np.split(order, cuts) if order.size else []:
            short = (keys[part] & np.uint64(0xFFFFFFFF)).astype("<u4")
            made.append((int(where[part[0]]), g, short.tobytes(), np.packbits(multi[part]).tobytes()))
        cols = list(zip(*made)) if made else [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["b", "g", "keys", "multi"])

    def match_keys(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()]
        multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=p.size) for m, p in zip(t.column("multi").to_pylist(), parts)]).astype(bool)
        _, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        known = counts > 1
        np.logical_or.at(known, place, multi)
        hit, made, at = known[place], [], 0
        b = t.column("b")[0].as_py()
        for g, p in zip(t.column("g").to_pylist(), parts):
            mine = hit[at : at + p.size]
            at += p.size
            if mine.any():
                made.append((g, b, np.packbits(mine).tobytes()))
        cols = list(zip(*made)) if made else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], [group, "b", "blob"])

    def send_runs(rows: pa.Table, notes: pa.Table) -> pa.Table:
        keys, _, each = _group_keys(list(_rows(rows, id_col, text_col, _copies(notes))))
        where, hit = buckets_of(keys, buckets), np.zeros(keys.size, bool)
        for b, blob in zip(notes.column("b").to_pylist(), notes.column("blob").to_pylist()):
            if b >= 0:
                mine = np.flatnonzero(where == b)
                hit[mine] = np.unpackbits(np.frombuffer(blob, np.uint8), count=mine.size).astype(bool)
        found = _distinct_runs(each, keys[hit])
        g = rows.column(group)[0].as_py() if rows.num_rows else 0
        wanted = keys[hit]
        to = dict(zip(wanted.tolist(), buckets_of(wanted, buckets).tolist()))
        by: dict[int, list] = {}
        for key, contents in found.items():
            for content, places in contents.items():
                ids = [each[k][0] for k, _ in places]
                by.setdefault(to[key], []).append((key, content, min(ids), max(ids)))
        made = []
        for b, own in by.items():
            ks, cs, lo, hi = zip(*own)
            made.append((b, g, b"".join(cs), *(np.array(v, k).tobytes() for v, k in ((list(map(len, cs)), "<u2"), (ks, "<u8"), (lo, "<i8"), (hi, "<i8")))))
        cols = list(zip(*made)) if made else [()] * 7
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["b", "g", "text", "lens", "keys", "least", "most"])

    def match_runs(t: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        least: list[int] = []
        sent = []
        for g, text, lens, keys, lo, hi in zip(*(t.column(c).to_pylist() for c in ("g", "text", "lens", "keys", "least", "most"))):
            at, numbers = 0, []
            lo = np.frombuffer(lo, "<i8").tolist()
            for n, d in zip(np.frombuffer(lens, "<u2").tolist(), lo):
                k = distinct.setdefault(text[at : at + n], len(least))
                at += n
                if k == len(least):
                    least.append(d)
                elif d < least[k]:
                    least[k] = d
                numbers.append(k)
            sent.append((g, np.array(numbers), np.frombuffer(keys, "<u8"), np.frombuffer(hi, "<i8")))
        lens = np.fromiter(map(len, distinct), np.int64, len(distinct))
        start, count = np.cumsum(lens) - lens, lens - WINDOW + 1
        from_ = np.cumsum(count) - count
        pos = np.repeat(start - from_, count) + np.arange(count.sum())
        doc = np.repeat(np.array(least, np.int64), count)
        classes = deep_shallow(b"".join(distinct), pos)
        shared = np.flatnonzero(classes >= 0)
        if shared.size:
            lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, classes[shared], doc[shared])
            doc[shared] = lowest[classes[shared]]
        lowest_of_run = np.minimum.reduceat(doc, from_)
        b, made = t.column("b")[0].as_py(), []
        for g, numbers, keys, most in sent:
            useful = np.unique(keys[lowest_of_run[numbers] < most])
            # all runs of a useful key go back, by key and then in the order in which they came, that of their bytes
            take = np.flatnonzero(np.isin(keys, useful))
            take = take[np.argsort(keys[take], kind="stable")]
            if take.size:
                many = count[numbers[take]]
                at = np.repeat(from_[numbers[take]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                blob = np.array([take.size], "<u8").tobytes() + keys[take].astype("<u8").tobytes() + doc[at].astype("<i8").tobytes()
                made.append((g, b, zlib.compress(blob, 1)))
        cols = list(zip(*made)) if made else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], [group, "b", "blob"])

    def mark(rows: pa.Table, notes: pa.Table) -> pa.Table:
        copies_here = _copies(notes)
        looked = list(_rows(rows, id_col, text_col, copies_here))
        each = [(d, raw, *r) for (d, raw), r in zip(looked, runs_of([raw for _, raw in looked]))]
        answers = []
        for b, blob in zip(notes.column("b").to_pylist(), notes.column("blob").to_pylist()):
            if b >= 0:
                blob = zlib.decompress(blob)
                n = int(np.frombuffer(blob, "<u8", 1)[0])
                answers.append((np.frombuffer(blob, "<u8", n, 8), np.frombuffer(blob, "<i8", -1, 8 + 8 * n)))
        wanted = np.unique(np.concatenate([k for k, _ in answers])) if answers else np.zeros(0, np.uint64)
        found = _distinct_runs(each, wanted)
        # one more place than bytes, as what covers the last byte ends there
        begin = np.cumsum([0] + [len(raw) + 1 for _, raw in looked])
        edges = np.zeros(int(begin[-1]), np.int32)
        for keys, lowest in answers:
            at, spots = 0, []
            for key in dict.fromkeys(keys.tolist()):
                for content, places in found[key].items():
                    n = len(content) - WINDOW + 1
                    spots += [(k, a, n, at) for k, a in places]
                    at += n
            if spots:
                k, a, n, low = np.array(spots, np.int64).T
                before = np.cumsum(n) - n
                step = np.arange(int(n.sum()))
                ids = np.array([d for d, _ in looked], np.int64)[k]
                covers = lowest[np.repeat(low - before, n) + step] < np.repeat(ids, n)
                where = (np.repeat(begin[k] + a - before, n) + step)[covers]
                # a window of a document is in one run only
                edges[where] += 1
                edges[where + WINDOW] -= 1
        masks = (np.cumsum(edges[a:z]) > 0 for a, z in zip(begin[:-1].tolist(), (begin[1:] - 1).tolist()))
        removed: list[np.ndarray | None] = []
        for d, text in zip(rows.column(id_col).to_pylist(), rows.column(text_col).to_pylist()):
            raw = text.encode(errors="surrogatepass")
            removed.append(np.ones(len(raw), bool) if copies_here.has(d, raw) else next(masks))
        return finish(rows.drop_columns([group]), removed)

    def marked_rows(rows: pa.Table, notes: pa.Table) -> pa.Table:
        try:
            return mark(rows, notes)
        finally:  # the last look; later stages run in the same workers
            give_back()

    def untouched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            yield from finish(pa.Table.from_batches([b]), [None] * b.num_rows).to_batches()

    grouped = base.groupBy(group)
    keys = grouped.cogroup(copies.groupBy(group)).applyInArrow(send_keys, "b int, g int, keys binary, multi binary")
    several = keys.groupBy("b").applyInArrow(match_keys, f"`{group}` int, {note}")
    sent = grouped.cogroup(several.unionByName(copies).groupBy(group)).applyInArrow(
        send_runs, "b int, g int, text binary, lens binary, keys binary, least binary, most binary"
    )
    answers = sent.groupBy("b").applyInArrow(match_runs, f"`{group}` int, {note}")
    marked = grouped.cogroup(answers.unionByName(copies).groupBy(group)).applyInArrow(marked_rows, schema)
    return marked.unionAll(docs.where(~takes_part).mapInArrow(untouched, schema))


def _kept(text: str | None, mask: np.ndarray | None) -> bytes:
    raw = (text or "").encode(errors="surrogatepass")
    return raw if mask is None else np.frombuffer(raw, np.uint8)[~mask].tobytes()


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What removing repeated 50-byte strings leaves of each document, as digests.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id;
    the input alone decides, and no string crosses documents. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256. Null and empty texts and those under 50 bytes lose nothing.
    Rows that share an id, whatever their texts, are one document for the comparison and leave each
    other alone; rows with a null id keep all and count for no one. An empty table gives an empty result; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(rows: pa.Table, removed: list) -> pa.Table:
        made = []
        for d, text, mask in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), removed):
            n = len((text or "").encode(errors="surrogatepass"))
            gone = 0 if mask is None else int(mask.sum())
            spans = 0 if mask is None else int(np.count_nonzero(np.diff(np.concatenate(([0], mask.view(np.int8)))) == 1))
            made.append((d, n, gone, spans, hashlib.sha256(_kept(text, mask)).hexdigest()))
        cols = list(zip(*made)) if made else [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return find_repeats(docs, finish, schema, id_col="doc_id", text_col="text", group_bytes=group_bytes, bucket_bytes=bucket_bytes)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with repeated strings cut out of their texts, all rows and columns kept.

    A character of which any byte goes is cut out whole. ``length_col``, if there is one, is set
    to the new length. For the rest see :func:`repeats`.
    """
    schema = docs.schema

    def finish(rows: pa.Table, removed: list) -> pa.Table:
        texts = [t if m is None else _kept(t, m).decode(errors="ignore") for t, m in zip(rows.column(text_col).to_pylist(), removed)]
        out = rows
        at = out.schema.get_field_index(text_col)
        out = out.set_column(at, text_col, pa.array(texts, out.schema.field(at).type))
        if length_col in out.schema.names:
            at = out.schema.get_field_index(length_col)
            out = out.set_column(at, length_col, pa.array([None if t is None else len(t) for t in texts], out.schema.field(at).type))
        return out

    return find_repeats(docs, finish, schema, id_col=id_col, text_col=text_col, group_bytes=group_bytes, bucket_bytes=bucket_bytes)
