"""Language identification by string kernels: Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import hash_sample, slices, small_batches, with_unsigned_crc, written

#: Rows that training reads at most, and landmarks among them.
TRAIN_ROWS = 12_000
LANDMARKS = 240
#: Cells of a landmark at most; all landmarks together are LANDMARKS times four times that in bytes, 16 MB.
MARK_CELLS = 1 << 14
#: Cells that n-grams are hashed into: so many that even long texts fill a small part of them.
CELLS = 1 << 20
LONGEST = 4
FOLDS, HELD_OUT = 3, 1


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter of any script (Unicode category L)."""
    return any(map(str.isalpha, text or ""))


class Presence:
    """Finds the cells of a text's n-grams; keeps one table of places, so that a text costs its own length."""

    def __init__(self, cells: int = CELLS):
        self.last = np.zeros(cells, np.int32)
        self.shift = np.uint32(32 - (cells.bit_length() - 1))

    def _distinct(self, parts: list[np.ndarray]) -> np.ndarray:
        found = np.concatenate(parts)
        at = np.arange(found.size, dtype=np.int32)
        self.last[found] = at
        return found[self.last[found] == at]

    def cells(self, text: str | None) -> np.ndarray:
        """The distinct cells of the hashed 1- to 4-grams of a whole text's bytes, lower-cased.

        The blended-spectrum presence kernel of two texts is the number of cells that they share:
        distinct n-grams of all lengths together.
        """
        b = (text or "").lower().encode(errors="surrogatepass")
        chunks = [np.zeros(0, np.uint32)]
        for at in range(0, len(b), 1 << 18):
            x = np.frombuffer(b[at : at + (1 << 18) + LONGEST - 1], np.uint8).astype(np.uint32)
            code, parts = np.zeros(x.size, np.uint32), []
            for n in range(1, min(LONGEST, x.size) + 1):
                code = code[: x.size - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
                parts.append((code * np.uint32(0x9E3779B1)) >> self.shift)
            chunks.append(self._distinct(parts))
        return chunks[-1] if len(chunks) == 2 else self._distinct(chunks)


def sparse_sums(rows: list[np.ndarray], table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Products of presence rows of unit length with a table that has rows for some cells only.

    ``place`` is the row of ``table`` of each cell, len(table) for those without.
    """
    out = np.zeros((len(rows), table.shape[1]), np.float32)
    for r, cells in zip(out, rows):
        if cells.size:
            at = place[cells]
            at = at[at < len(table)]
            for k in range(0, at.size, 1 << 13):
                r += table[at[k : k + (1 << 13)]].sum(axis=0, dtype=np.float32)
            r /= np.float32(np.sqrt(cells.size))
    return out


def placed(used: np.ndarray, cells: int) -> np.ndarray:
    """The row of each cell in a table of the used ones."""
    place = np.full(cells, used.size, np.int32)
    place[used] = np.arange(used.size)
    return place


def landmark_table(marks: list[np.ndarray], used: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the used cells in each landmark, a byte each, and what gives the landmarks unit length."""
    table = np.zeros((used.size, len(marks)), np.uint8)
    for k, m in enumerate(marks):
        table[place[m], k] = 1
    return table, np.array([1 / np.sqrt(m.size) for m in marks], np.float32)


@dataclass
class Model:
    """Landmark rows times coefficients, with the intercepts: one column a language, one row a used cell."""

    langs: list[str]
    used: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    cells: int = CELLS

    def values(self, texts: Iterable[str | None], presence: Presence, place: np.ndarray) -> np.ndarray:
        """Regression values of texts, one column a language."""
        return sparse_sums([presence.cells(t) for t in texts], self.weights, place) + self.bias


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = TRAIN_ROWS,
    landmarks: int = LANDMARKS,
    cells: int = CELLS,
    ridge: float = 1e-2,
    mark_cells: int = MARK_CELLS,
) -> Model | None:
    """Fit on at most about ``rows`` rows outside the held-out fold with a language and a letter.

    Landmarks are a bounded draw from them, as many for each language; one with more than
    ``mark_cells`` cells stands for every second, third and so on of them, so that what comes to the
    driver and is broadcast has a bound whatever the texts' lengths. Tasks sum the normal
    equations of one-versus-rest ridge regression on the Nyström features, and the driver
    solves them, whose size is that of the landmarks. None if there is nothing to learn from.
    """
    spark = small_batches(docs).sparkSession
    known = with_unsigned_crc(docs, "__fold", id_col, FOLDS).where(
        F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.coalesce("__fold", F.lit(HELD_OUT)) != HELD_OUT)
    )
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = written(hash_sample(known.select("lang", "text", F.xxhash64("lang", "text").alias("h")), rows, "h"), "lang-sample")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    each = max(1, landmarks // len(langs))
    drawn = known.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, text)")).where(F.col("k") <= each)

    def present(it):
        found = Presence(cells)
        for b in slices(it):
            marks = [found.cells(t) for t in b.column(2).to_pylist()]
            raw = [np.sort(m)[:: max(1, -(-m.size // mark_cells))].astype("<i4").tobytes() for m in marks]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["lang", "k", "cells"])

    # the landmarks' cells come to the driver, not their texts
    got = drawn.select("lang", "k", "text").mapInArrow(present, "lang string, k int, cells binary").collect()
    marks = [np.frombuffer(r.cells, "<i4") for r in sorted(got, key=lambda r: (r.lang, r.k))]
    used = np.unique(np.concatenate(marks))
    place = placed(used, cells)
    table, unit = landmark_table(marks, used, place)
    kernel = sparse_sums(marks, table, place) * unit
    values, vectors = np.linalg.eigh(((kernel + kernel.T) / 2).astype(float))
    keep = values > 1e-6 * values[-1]
    project = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    weights = {k: sum(counts.values()) / len(langs) / n for k, n in counts.items()}
    shared = spark.sparkContext.broadcast((langs, used, marks, project, weights))

    def sums(it):
        names, used, marks, project, weight = shared.value
        number, place, found = {name: i for i, name in enumerate(names)}, placed(used, cells), Presence(cells)
        table, unit = landmark_table(marks, used, place)
        m = project.shape[1] + 1
        xx, xy = np.zeros((m, m)), np.zeros((m, len(names)))
        for b in slices(it):
            kernel = sparse_sums([found.cells(t) for t in b.column("text").to_pylist()], table, place) * unit
            x = np.hstack([kernel @ project, np.ones((b.num_rows, 1), np.float32)]).astype(float)
            y = np.full((b.num_rows, len(names)), -1.0)
            y[np.arange(b.num_rows), [number[v] for v in b.column("lang").to_pylist()]] = 1
            # rare languages count as much as frequent ones
            w = np.array([weight[v] for v in b.column("lang").to_pylist()])[:, None]
            xx += x.T @ (w * x)
            xy += x.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([xx.tobytes()]), pa.array([xy.tobytes()])], ["xx", "xy"])

    m = project.shape[1] + 1
    xx, xy = np.zeros((m, m)), np.zeros((m, len(langs)))
    for r in known.select("lang", "text").coalesce(16).mapInArrow(sums, "xx binary, xy binary").collect():
        xx += np.frombuffer(r.xx).reshape(m, m)
        xy += np.frombuffer(r.xy).reshape(m, -1)
    penalty = np.eye(m) * ridge
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(xx + penalty, xy)
    folded, share = np.zeros((used.size, len(langs)), np.float32), project @ solved[:-1]
    for k, m in enumerate(marks):
        folded[place[m]] += (share[k] * unit[k]).astype(np.float32)
    return Model(langs, used, folded, solved[-1], cells)


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row.

    A text that is null or has no letter is ``und`` with score 0, as is any without a model; the
    others get the language of the largest regression value, the first by name of equal ones,
    and its softmax as score. Only the text decides. Rows that share an id stay rows of their
    own; a null id isn't held out; other columns are not looked at.
    """
    spark = small_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        found, place = (Presence(m.cells), placed(m.used, m.cells)) if m else (None, None)
        for b in slices(it):
            texts = b.column("text").to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if m and has_letter(t)]
            if told:
                v = m.values([texts[i] for i in told], found, place)
                best = v.argmax(axis=1)
                e = np.exp(4 * (v - v.max(axis=1, keepdims=True)))
                for i, k, p in zip(told, best, 1 / e.sum(axis=1)):
                    lang[i], score[i] = m.langs[k], float(p)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = with_unsigned_crc(texts.mapInArrow(run, "doc_id long, lang_pred string, score double"), "__fold", "doc_id", FOLDS)
    return done.select("doc_id", F.coalesce(F.col("__fold") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
