"""From raw documents to packed training sequences: five stages, each an operator of ``tidewatch.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import mixing, packing, simhash, suffixes, toxicity
from tidewatch.llm.common import written
from tidewatch.llm.queries import vocabulary


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with names that no operator uses and that hold no dots, and what each column is called now."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the model calls toxic; it learns from the labelled ones.

    Null and empty texts have no features and score as the model's bias says, very long ones are
    read whole, equal texts score alike, so that repeated rows stay or go together. An empty table
    stays empty. All columns come back as they were, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, names = _plain(docs)
    scored = toxicity.score(inner, model, text_col=names["text"], score_col="score")
    return scored.where(F.col("score") < 0.5).drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Texts without words, null ones among them, are one group. Of equally similar documents the one
    with the smallest id stays, a null id last, and of repeated rows one. Whole texts are compared.
    An empty table stays empty. All columns come back as they were, whatever their names.
    """
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings that an earlier document has out of the texts; every document stays.

    Null texts stay null and empty ones empty; a null id's text is neither cut nor cut from; rows of
    one id don't cut each other; very long texts are treated whole. An empty table stays empty. All
    other columns come back as they were, whatever their names.
    """
    inner, names = _plain(docs)
    cut = suffixes.remove_repeats(inner, id_col=names["doc_id"], text_col=names["text"], length_col=names.get("n_chars", "n_chars"))
    return cut.select(*names.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources weigh the square roots of their sizes.

    A null source is a source. Rows of one id are repeated equally often, a null id by its text. Null,
    empty and very long texts are rows like any other. An empty table stays empty. All columns come
    back as they were, whatever their names.
    """
    inner, names = _plain(docs)
    mixed = mixing.mix(inner, id_col=names["doc_id"], source_col=names["source"], text_col=names["text"])
    return mixed.select(*names.values()).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4,096 tokens, one row per piece.

    A null or empty text is an end token. Copies of a document are packed one by one, longer ones than
    a sequence in pieces. An empty table gives no rows.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Models, links and packing can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
