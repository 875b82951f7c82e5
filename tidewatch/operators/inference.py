"""Classifiers inside tasks: one surface for all of them, and one for ONNX models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maps texts to shares of classes; made once a task.
Classifier = Callable[[Sequence[str]], list[dict[str, float]]]


def scores(load: Callable[[], Classifier], classes: Sequence[str]) -> Callable[[Column], Column]:
    """A function of a text column to a map with every class; one that the classifier doesn't name has share 0."""
    names = list(classes)

    @F.pandas_udf("map<string, double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = load()
        for texts in batches:
            told = classify([t or "" for t in texts])
            yield pd.Series([{c: float(one.get(c, 0.0)) for c in names} for one in told], dtype=object)

    return run


class Exhausted(Exception):
    """A classifier has used up what it may do for now."""


class AllExhausted(Exception):
    """No classifier is left; the first may be asked again after so many seconds."""

    def __init__(self, after_s: float):
        super().__init__(f"all classifiers are exhausted for {after_s:.0f} s")
        self.retry_after_s = after_s


class Fallback:
    """Classifiers asked one after the other; one that is exhausted isn't asked again until it has cooled down.

    Of a batch of texts those that a classifier answered before it was exhausted keep its answers. It
    may say how many by the second argument of ``Exhausted``: ``Exhausted("quota", answers)``.
    """

    def __init__(self, classifiers: Sequence[tuple[str, Classifier]], cool_s: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        if not classifiers:
            raise ValueError("a fallback needs one classifier at least")
        self.classifiers, self.cool_s, self.clock = list(classifiers), cool_s, clock
        self.open_until = dict.fromkeys((name for name, _ in classifiers), 0.0)

    def __call__(self, texts: Sequence[str]) -> list[tuple[str, dict[str, float]]]:
        """The name of the one that answered and its shares, for each text."""
        out: list[tuple[str, dict[str, float]]] = []
        for name, classify in self.classifiers:
            left = texts[len(out) :]
            if not left:
                break
            if self.open_until[name] > self.clock():
                continue
            try:
                out += [(name, told) for told in classify(left)]
            except Exhausted as e:
                out += [(name, told) for told in (e.args[1] if len(e.args) > 1 else [])]
                self.open_until[name] = self.clock() + self.cool_s
        if len(out) < len(texts):
            raise AllExhausted(max(0.0, min(self.open_until.values()) - self.clock()))
        return out


def scores_with_fallback(
    load: Callable[[], Sequence[tuple[str, Classifier]]], classes: Sequence[str], cool_s: float = 3600.0, clock: Callable[[], float] = time.monotonic
) -> Callable[[Column], Column]:
    """A function of a text column to the name of the classifier that answered and its shares.

    Which classifiers are exhausted is kept by a task for its batches of texts. If all are, the task
    fails and with it the query or micro-batch, which is to be tried again later; nothing is lost.
    """
    names = list(classes)

    @F.pandas_udf("labeler string, scores map<string, double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = Fallback(load(), cool_s, clock)
        for texts in batches:
            told = ask([t or "" for t in texts])
            shares = [{c: float(one.get(c, 0.0)) for c in names} for _, one in told]
            yield pd.DataFrame({"labeler": [name for name, _ in told], "scores": pd.Series(shares, dtype=object)})

    return run


def top_class(told: Column, classes: Sequence[str]) -> Column:
    """The class with the largest share; the first of ``classes`` if several have it."""
    shares = F.transform(F.array(*map(F.lit, classes)), lambda c: F.element_at(told, c))
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(shares, F.array_max(shares)).cast("int"))


def token_batches(lengths: Sequence[int], most: int) -> Iterator[list[int]]:
    """Rows in order of length, cut so that rows times the longest stay within ``most`` tokens; a row alone may exceed them."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) + 1) * max(1, lengths[i]) > most:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits.astype(np.float64) - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def by_session(session, encode: Callable[[str], list[int]], classes: Sequence[str], max_len: int, max_tokens: int = 4096, pad: int = 0) -> Classifier:
    """A classifier of an ONNX session over token ids; texts are cut to ``max_len`` tokens, the model's own limit."""
    if max_tokens < max_len:
        raise ValueError("a batch has to hold one text of the greatest length")
    takes = {i.name for i in session.get_inputs()}

    def classify(texts: Sequence[str]) -> list[dict[str, float]]:
        ids = [encode(t)[:max_len] for t in texts]
        out: list[dict[str, float]] = [{}] * len(ids)
        for rows in token_batches([len(x) for x in ids], max_tokens):
            given = np.full((len(rows), max(1, max(len(ids[i]) for i in rows))), pad, np.int64)
            mask = np.zeros_like(given)
            for at, i in enumerate(rows):
                given[at, : len(ids[i])] = ids[i]
                mask[at, : len(ids[i])] = 1
            feeds = {"input_ids": given, "attention_mask": mask, "token_type_ids": np.zeros_like(given)}
            told = softmax(session.run(["logits"], {k: v for k, v in feeds.items() if k in takes})[0])
            for at, i in enumerate(rows):
                out[i] = dict(zip(classes, told[at].tolist()))
        return out

    return classify


def to_infer(events: DataFrame, known: DataFrame) -> DataFrame:
    """(post_id, text, text_hash, infer) of a batch's posts: the last row of each, deleted ones left out.

    ``events(post_id, text, op, is_deleted, seq)`` and ``known(post_id, text_hash)``. A text is inferred
    if it differs from the known one, or if none is known and the post was created in this batch.
    """
    last = events.groupBy("post_id").agg(
        F.max_by(F.struct("text", "is_deleted"), "seq").alias("last"), F.bool_or(F.col("op") == "c").alias("created")
    )
    alive = last.where(~F.coalesce("last.is_deleted", F.lit(False)))
    text = F.coalesce("last.text", F.lit(""))
    rows = alive.select("post_id", "created", text.alias("text"), F.sha2(text, 256).alias("text_hash"))
    told = rows.join(known.select("post_id", F.col("text_hash").alias("__known")), "post_id", "left")
    infer = F.when(F.col("__known").isNull(), F.col("created")).otherwise(F.col("__known") != F.col("text_hash"))
    return told.withColumn("infer", F.coalesce(infer, F.lit(False))).drop("created", "__known")
