"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import dropped, hash_sample, slices, small_batches, unused, with_unsigned_crc, written

#: Labelled rows that training reads at most, and bytes of their features, 4 for each.
TRAIN_ROWS = 30_000
TRAIN_BYTES = 256 << 20
BITS = 20
FOLDS, HELD_OUT = 5, 0

#: ASCII but letters and digits separates words; bytes of other scripts belong to words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_CACHE: dict[bytes, int] = {}
_CACHE_MOST = 50_000


class _Hashes(dict):
    """Hash of each word seen; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _CACHE_MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: words, word pairs, and pairs with one word between."""
    words = (text or "").encode(errors="surrogatepass").lower().translate(_WORDS).split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    one, two, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - bits)
    parts = [h, h[:-1] * one + h[1:] * two, h[:-2] * two + h[2:] * one + one]
    mixed = np.concatenate(parts) * one
    return np.unique((mixed >> shift).astype(np.int32))


@dataclass
class Model:
    """Weights that aren't zero, as sorted feature numbers and values, and the intercept."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.value
        return w


def ftrl(
    batches, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0
) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass over (features, label) pairs; every feature has its own learning rate."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for idx, label in batches:
        w = weight(z[idx], n[idx])
        w0 = -z0 / ((beta + n0**0.5) / alpha)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
        old = n[idx]
        n[idx] = old + g * g
        z[idx] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
        z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
        n0 += g * g
    w = weight(z, n)
    index = np.flatnonzero(w)
    return index.astype(np.int32), w[index].astype(np.float32), float(-z0 / ((beta + n0**0.5) / alpha))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
    size: int = TRAIN_BYTES,
    epochs: int = 3,
    bits: int = BITS,
) -> Model:
    """Fit on at most about ``rows`` labelled documents outside the held-out fold.

    Labels are made unique by id first (1 wins over 0); rows with a null id or label are left
    out. Features are made where the texts lie and written; if they are more than ``size`` bytes,
    because texts are very long, fewer rows are drawn. One task then runs the sequential updates
    over the bounded sample, ordered by a hash; it reads each batch once and keeps the rows in a
    temporary file of its own for the later epochs, so that its memory doesn't grow with the sample.
    Rows that share an id count one by one with the id's label; null and empty texts have no
    features. Without any labelled row the model scores 0.5.
    """
    spark = small_batches(docs).sparkSession
    known = with_unsigned_crc(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()), "__fold", id_col, FOLDS)
    known = known.where(F.col("__fold") != HELD_OUT).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    # the sample's size is bounded, and so is what is broadcast here
    picked = F.broadcast(written(hash_sample(known, rows, "__id"), "toxic-sample"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(picked, "__id")

    def featurize(it):
        for b in slices(it):
            d = b.to_pydict()
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["__id"], pa.int64()), pa.array(d["__y"], pa.int32()), pa.array([features(t, bits).tobytes() for t in d["__text"]], pa.binary())],
                ["id", "y", "x"],
            )

    made = texts.select(F.col("__id").cast("long").alias("__id"), "__y", "__text").mapInArrow(featurize, "id long, y int, x binary")
    made = kept_features = written(made, "toxic-features")
    total = made.agg(F.sum(F.length("x"))).first()[0] or 0
    if total > size:
        made = hash_sample(made, int(made.count() * size / total), "id", seed=19)
    made = made.withColumn("o", F.xxhash64(F.lit(3), "id")).repartition(1).sortWithinPartitions("o", "id", "x")

    def fit(it):
        with tempfile.TemporaryFile() as kept:

            def again() -> Iterator[tuple[np.ndarray, int]]:
                for b in slices(it):
                    for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                        y = int(y > 0)
                        kept.write(len(x).to_bytes(4, "little") + bytes([y]) + x)
                        yield np.frombuffer(x, np.int32), y
                for _ in range(epochs - 1):
                    kept.seek(0)
                    while head := kept.read(5):
                        yield np.frombuffer(kept.read(int.from_bytes(head[:4], "little")), np.int32), head[4]

            index, value, bias = ftrl(again(), bits)
        yield pa.RecordBatch.from_arrays([pa.array([index.tobytes()]), pa.array([value.tobytes()]), pa.array([bias])], ["i", "v", "b"])

    got = made.select("y", "x").mapInArrow(fit, "i binary, v binary, b double").collect()
    dropped(kept_features)
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, bits)
    return Model(np.frombuffer(got[0].i, np.int32), np.frombuffer(got[0].v, np.float32), got[0].b, bits)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text, null texts as empty ones.

    A column of ``docs`` with the score's name is replaced, all others stay. Scores depend on the
    text alone; equal texts score alike. An empty table gives an empty result.
    """
    spark = small_batches(docs).sparkSession
    docs = docs.drop(score_col)
    shared = spark.sparkContext.broadcast((model.index, model.value, model.bias, model.bits))

    def run(it):
        m = Model(*shared.value)
        w, bias = m.dense(), m.bias
        for b in slices(it):
            s = [float(w[features(t, m.bits)].sum()) + bias for t in b.column(b.num_columns - 1).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(s, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], [*b.schema.names[:-1], score_col])

    out = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(unused("__scored", docs.columns), F.col(text_col).cast("string")).mapInArrow(run, out)


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id isn't held out."""
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    scored = with_unsigned_crc(scored, "__fold", "doc_id", FOLDS)
    return scored.select(
        "doc_id",
        F.coalesce(F.col("__fold") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
