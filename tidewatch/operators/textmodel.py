"""A baseline text classifier: character n-grams, smoothed TF-IDF with sublinear TF, balanced logistic regression.

A text's n-grams are counted where it lies. The counts are rows (text, term, n), from which Spark takes the
vocabulary; with it a text is a sparse vector, again where it lies, so that vectors are neither sent nor written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import grams
from tidewatch.sources.scratch import scratch_path

VOCABULARY = 200_000
#: Texts that a term occurs in at least.
LEAST_TEXTS = 2
#: How a sparse vector lies in a file.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
SCORED = "predicted string, scores map<string, double>"
#: Rows of an Arrow batch, as rows hold whole texts and their vectors.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches; the setting is read when a query runs, a smaller one is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def term_counts(rows: DataFrame, text: str) -> DataFrame:
    """(row, term, n) of the 1- to 3-grams of characters inside words that are padded with a space on either side."""
    _small_batches(rows.sparkSession)
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return rows.select("row", _plain(F.col(text))).mapInArrow(grams.counts, kind)


def vocabulary(counts: DataFrame, texts: int, most: int = VOCABULARY) -> DataFrame:
    """(term, at, idf) of the terms of several texts, the ``most`` that occur most often, numbered from 0.

    The inverse document frequency is ln((texts + 1) / (texts with the term + 1)). The table is
    bounded by ``most``.
    """
    totals = counts.groupBy("term").agg(F.sum("n").alias("all"), F.count("*").alias("df")).where(F.col("df") >= LEAST_TEXTS)
    chosen = totals.orderBy(F.desc("all"), "term").limit(most)
    at = (F.row_number().over(Window.orderBy(F.desc("all"), "term")) - 1).cast("int")  # over the bounded table
    return chosen.select("term", at.alias("at"), F.log((F.lit(texts) + 1) / (F.col("df") + 1)).alias("idf"))


def weights(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, at, weight): (1 + ln n) * idf of the known terms, each row scaled to length 1."""
    told = counts.join(F.broadcast(terms), "term").select("row", "at", ((1 + F.log("n")) * F.col("idf")).alias("w")).where("w <> 0")
    length = told.groupBy(F.col("row").alias("__r")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return told.join(length, F.col("row") == F.col("__r")).select("row", "at", (F.col("w") / F.col("length")).alias("weight"))


def vectors(rows: DataFrame, weighted: DataFrame, size: int) -> DataFrame:
    """(row, features) of all ``rows``: their weights as sparse vectors, written and read again as what they are."""
    cells = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "weight"))))
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform("cells", lambda c: c["at"]).alias("indices"), F.transform("cells", lambda c: c["weight"]).alias("values"),
    )
    path = scratch_path(weighted.sparkSession, "vectors")
    rows.select("row").join(weighted, "row", "left").groupBy("row").agg(cells.alias("cells")).select("row", sparse.cast(_SPARSE).alias("features")).write.parquet(path)
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("features", VectorUDT())])
    return weighted.sparkSession.read.schema(kind).parquet(path)


def encoder(terms: DataFrame) -> Callable[[Column], Column]:
    """A function of a text column to sparse vectors, ``weights`` and ``vectors`` without rows for terms.

    ``terms`` is a vocabulary, whose bounded table is sent to all tasks.
    """
    spark = terms.sparkSession
    _small_batches(spark)
    told = terms.select("term", "at", "idf").toArrow()
    sent = spark.sparkContext.broadcast(grams.Weights(told["term"].to_pylist(), told["at"].to_numpy(), told["idf"].to_numpy()))

    @F.arrow_udf(VectorUDT())
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield sent.value.vectors(some)

    return lambda text: encode(_plain(text))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    every = Window.partitionBy()  # over one row a class
    shares = counts.withColumn("weight", F.sum("__n").over(every) / (F.count("*").over(every) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(shares), label)


def fit(features: DataFrame, classes: list[str], label: str, *, regularisation: float = 0.0, rounds: int = 20) -> LogisticRegressionModel:
    """A balanced multinomial model of ``features(features, label)``; Spark adds up gradients by trees."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    rows = balanced(features, label).withColumn("__y", number.cast("double"))
    lr = LogisticRegression(labelCol="__y", weightCol="weight", maxIter=rounds, regParam=regularisation, family="multinomial", standardization=False)
    return lr.fit(rows)


def fit_predict(train: DataFrame, rows: DataFrame, text: str = "text", label: str = "polarity", regularisation: float = 0.0) -> DataFrame:
    """Fit on ``train`` and add ``predicted`` and ``scores``, a map of classes, to all ``rows``.

    Rows whose label is null aren't learnt from. Null and empty texts, and those of unknown terms
    alone, have no weights and are scored by the model's intercepts. With one class every row is
    that class; without any, ``predicted`` and ``scores`` are null. Columns of those names are replaced.
    ``train`` is read several times, so it should lie in files, and in as many parts as there are tasks.
    """
    keep = [c for c in rows.columns if c not in ("predicted", "scores")]
    known = train.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("y")).where("y IS NOT NULL")
    tally = known.groupBy("y").count().collect()  # a row for each class
    classes = sorted(r[0] for r in tally)
    if len(classes) < 2:
        only = F.lit(classes[0] if classes else None).cast("string")
        sure = F.create_map(only, F.lit(1.0)) if classes else F.lit(None).cast("map<string, double>")
        return rows.select(*[F.col(f"`{c}`") for c in keep], only.alias("predicted"), sure.alias("scores"))

    counts = term_counts(known.select(F.monotonically_increasing_id().alias("row"), "t"), "t")
    encode = encoder(vocabulary(counts, sum(r[1] for r in tally)))
    model = fit(known.select(encode(F.col("t")).alias("features"), "y"), classes, "y", regularisation=regularisation)

    asked = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), encode(F.col(f"`{text}`")).alias("features"))
    scored = model.transform(asked)
    names = F.array(*map(F.lit, classes))
    best = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    return scored.select("r.*", best.alias("predicted"), F.map_from_arrays(names, vector_to_array("probability")).alias("scores"))


def held_out(rows: DataFrame, id_col: str, text: str = "text", label: str = "polarity", folds: int = 2) -> DataFrame:
    """Every row scored by a model that hasn't seen it: rows are dealt to folds by their id's CRC, a null id to the first.

    Rows are written once, in the parts that they come in.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))
    made, out = rows.withColumn("__fold", fold), None
    path = scratch_path(rows.sparkSession, "dealt")
    made.write.parquet(path)
    dealt = rows.sparkSession.read.schema(made.schema).parquet(path)
    for k in range(folds):
        mine = fit_predict(dealt.where(F.col("__fold") != k), dealt.where(F.col("__fold") == k), text, label).drop("__fold")
        out = mine if out is None else out.unionByName(mine)
    return out
