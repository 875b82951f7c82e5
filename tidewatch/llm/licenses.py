"""License scans: an exact set-similarity join of text blocks with license templates, all in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

# Base phrases with their labels, and the templates with theirs and the words that name
# them, which must stand one after the other.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby granted"),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "apache org"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "gnu general public license"),
    ("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered software"),
]
#: What stands between words: every ASCII character but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text whose A-Z are lower-case already."""
    return F.array_remove(F.split(text, GAP), "")


def places(found: Column, phrase: str) -> Column:
    """Word numbers at which a phrase starts."""
    parts = phrase.split()
    n = len(parts)
    return F.when(
        (F.size(found) >= n) & F.array_contains(found, parts[-1]) & F.array_contains(found, parts[0]),
        F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(found) - n, F.lit(0))),
            lambda i: F.slice(found, i + 1, n) == F.array(*map(F.lit, parts)),
        ),
    ).otherwise(F.array().cast("array<int>"))


def template_blocks(blocks: DataFrame, templates: list[tuple[str, ...]], threshold: float) -> DataFrame:
    """(key columns, label, containment) of each block that holds the threshold of a template's words.

    ``blocks`` has ``hits``, its distinct words that occur in any template, ``span``, the words of the
    templates that it is cut for, ``named``, the numbers of the templates whose naming words stand
    in it, and key columns. Words are ordered from rare to frequent by the number of blocks with
    them. A block that holds enough of a template shares one of the template's rarest words with it,
    so that an equi-join on these finds every such pair; sizes and positions of the shared word leave
    out most others before the sets are compared.
    """
    spark, keys = blocks.sparkSession, [c for c in blocks.columns if c not in ("hits", "span", "named")]
    freq = blocks.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # these frames are bounded by the templates' words
    seen = {r["word"]: r["n"] for r in freq.collect()}
    sets = [(i, t[0], sorted(set(_plain_words(t[1])), key=lambda w: (seen.get(w, 0), w)), template_span(t)) for i, t in enumerate(templates)]
    order = sorted({w for _, _, s, _ in sets for w in s}, key=lambda w: (seen.get(w, 0), w))
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])
    ranks = {w: i for i, w in enumerate(order)}
    prefixes = spark.createDataFrame(
        [
            (ranks[w], span, i, at, len(s), _need(s, threshold), label, [ranks[x] for x in s])
            for i, label, s, span in sets
            for at, w in enumerate(s[: len(s) - _need(s, threshold) + 1])
        ],
        "__rank int, span int, __template int, __at int, __size int, __need int, label string, __set array<int>",
    )
    held = blocks.withColumn("__held", F.array_sort(F.transform("hits", lambda w: rank[w]))).drop("hits")
    found = held.select(*keys, "span", "named", "__held", F.posexplode("__held").alias("__pos", "__rank")).join(F.broadcast(prefixes), ["__rank", "span"])
    left = F.least(F.col("__size") - F.col("__at"), F.size("__held") - F.col("__pos"))
    # the pair meets at its first common word, so no word of either before it is shared
    found = found.where((F.size("__held") >= F.col("__need")) & (left >= F.col("__need")) & F.array_contains("named", F.col("__template")))
    shared = F.size(F.array_intersect("__held", "__set"))
    found = found.withColumn("__shared", shared).where(F.col("__shared") >= F.col("__need"))
    return found.select(*keys, "label", (F.col("__shared") / F.col("__size")).alias("containment"))


def _need(words: list[str], threshold: float) -> int:
    """So many of a template's words meet the threshold."""
    return math.ceil(threshold * len(words) - 1e-9)


def template_span(template: tuple[str, ...]) -> int:
    """Words of a template, repeated ones too."""
    return len(_plain_words(template[1]))


def naming_words(template: tuple[str, ...]) -> list[str]:
    """The words that must stand in a block one after the other; none, if the template gives none."""
    return _plain_words(template[2]) if len(template) > 2 else []


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, ...]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """License phrases and templates in whole texts, one row per document.

    Places are word numbers at which a base phrase stands. Blocks of the template join are windows
    of twice a template's words that start at each multiple of them, for each template by itself,
    so that any stretch as long as the template lies whole in one, however its lines are wrapped,
    and words further apart don't meet. A block matches if it holds the threshold of the template's
    distinct words and, one after the other, the words that name its license. ``score`` is 1 with a
    base phrase, else the largest containment of a template found, else 0. A text is split into
    words once; only texts that hold enough words of some template are cut into blocks, as no block
    of another can match. Null and empty texts have no words; a very long text is cut like any other.
    Rows that share an id stay rows of their own; a null id is an id; an empty table gives an empty
    result; other columns are not looked at.
    """
    templates = TEMPLATES if templates is None else templates
    sets = [sorted(set(_plain_words(t[1]))) for t in templates]
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets))])
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    told = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")).withColumn("__words", words(F.col("__text")))
    told = told.withColumns({f"__p{i}": places(F.col("__words"), p) for i, p in enumerate(BASE_PHRASES)})
    told = told.withColumn("__hits", F.array_intersect("__words", vocabulary))
    every = F.concat(*[F.col(f"__p{i}") for i in range(len(BASE_PHRASES))])
    labels = F.array_compact(
        F.array(*[F.when(F.size(f"__p{i}") > 0, F.lit(label)) for i, label in enumerate(BASE_PHRASES.values())])
    )
    spans = []
    for t, s in zip(templates, sets):
        enough = F.size(F.array_intersect("__hits", F.array(*map(F.lit, s)))) >= _need(s, threshold)
        for w in naming_words(t):
            enough &= F.array_contains("__words", w)
        spans.append(F.when(enough, F.lit(template_span(t))))
    told = told.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("__base"),
        F.array_distinct(F.array_compact(F.array(*spans))).alias("__spans"),
        "__text",
        F.monotonically_increasing_id().alias("__row"),
    )
    told = told.withColumn("__text", F.when(F.size("__spans") > 0, F.col("__text")))
    told = written(told, "licenses")

    cut = told.where(F.size("__spans") > 0).select("__row", "__spans", words(F.col("__text")).alias("__words"))
    cut = cut.select("__row", "__words", F.explode("__spans").alias("span"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__words") / F.col("span")) - 2, F.lit(0)).cast("int"))
    cut = cut.select("__row", "span", F.explode(F.transform(starts, lambda i: F.slice("__words", i * F.col("span") + 1, 2 * F.col("span")))).alias("w"))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    named = [F.when(line.contains(f" {' '.join(n)} ") if (n := naming_words(t)) else F.lit(True), F.lit(i)) for i, t in enumerate(templates)]
    least = min(_need(s, threshold) for s in sets)
    blocks = cut.select("__row", "span", F.array_intersect("w", vocabulary).alias("hits"), F.array_compact(F.array(*named)).alias("named"))
    blocks = blocks.where((F.size("hits") >= least) & (F.size("named") > 0))
    found = template_blocks(written(blocks, "blocks"), templates, threshold)
    found = found.groupBy(F.col("__row").alias("__found")).agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__most"))
    joined = told.drop("__text", "__spans").join(found, F.col("__row") == F.col("__found"), "left")
    own = F.coalesce("__labels", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__most", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: list[tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL that compares every window of each template's length with it."""
    templates = TEMPLATES if templates is None else templates
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    sets = [(t[0], sorted(set(_plain_words(t[1]))), template_span(t), " ".join(naming_words(t))) for t in templates]
    values = ", ".join(f"('{label}', {quoted(s)}, {len(s)}, {_need(s, threshold)}, {span}, '{name}')" for label, s, span, name in sets)
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in BASE_PHRASES.items())
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
),
told AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '{gap}'), lambda w: w <> '') AS w FROM base),
templates(label, s, size, need, span, name) AS (VALUES {values}),
phrases(p, label) AS (VALUES {phrases}),
blocks AS (
  SELECT r, label, s, size, need, name, w[i * span + 1 : i * span + 2 * span] AS w
  FROM (SELECT *, unnest(range(0, greatest(ceil(len(w) / span::DOUBLE)::BIGINT - 1, 1))) AS i FROM told, templates WHERE len(list_intersect(w, s)) >= need)
),
matched AS (
  SELECT r, label, len(list_intersect(w, s)) / size::DOUBLE AS c FROM blocks
  WHERE len(list_intersect(w, s)) >= need AND contains(' ' || array_to_string(w, ' ') || ' ', CASE WHEN name = '' THEN '' ELSE ' ' || name || ' ' END)
),
placed AS (
  SELECT r, label, i FROM (
    SELECT r, w, label, p, unnest(range(0, greatest(len(w) - len(p) + 1, 0))) AS i FROM told, phrases WHERE list_contains(w, p[1])
  ) WHERE w[i + 1 : i + len(p)] = p
),
b AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS l FROM placed GROUP BY r),
m AS (SELECT r, list(DISTINCT label) AS l, max(c) AS c FROM matched GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.c, 0.0) END::DOUBLE AS score
FROM told LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
