"""Topics of a message broker: reading, decoding and writing messages.

The broker's and Avro's connectors are Spark packages that a cluster adds with ``--packages``. A
recording (``sources.files``) can be streamed in a topic's place. Messages have the connector's columns:
topic, partition, offset, timestamp, key and value.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import base64
from tidewatch.sources.files import RECORD

COORDINATES = ("topic", "partition", "offset")
#: Bytes before the body in a message of a schema registry: a zero and the schema's number.
REGISTRY_HEADER = 5


def read_topic(spark: SparkSession, servers: str, topic: str, *, stream: bool = True, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Messages of a topic. A partition without any since that time starts at its end; only a batch has an end."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    if since_ms is not None:
        options |= {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
    if until_ms is not None:
        if stream:
            raise ValueError("a stream has no end")
        options |= {"endingTimestamp": str(until_ms)}
    return (spark.readStream if stream else spark.read).format("kafka").options(**options).load()


def stream_recording(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """The messages of recordings as a stream, in whichever order their files arrive."""
    lines = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).json(path)
    return lines.select(
        *COORDINATES, F.timestamp_millis("timestamp_ms").alias("timestamp"),
        F.unbase64("key_b64").alias("key"), F.unbase64("value_b64").alias("value"),
    )


def decode_json(messages: DataFrame, schema: str) -> DataFrame:
    """Add ``row``, the value read as JSON by the schema, and ``error``: null, "tombstone" or "json".

    Unknown fields are skipped and missing ones null.
    """
    read = F.from_json(F.col("value").cast("string"), schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    with_row = messages.withColumn("row", read)
    fault = F.when(F.col("value").isNull(), "tombstone").when(F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "json")
    return with_row.withColumn("error", fault).withColumn("row", F.col("row").dropFields("_corrupt"))


def decode_avro(messages: DataFrame, schema: str) -> DataFrame:
    """Add ``row``, the body after a registry's header read as Avro, and ``error``: null, "tombstone" or "avro".

    Needs Spark's Avro package. ``schema`` is the writer's, in JSON.
    """
    from pyspark.sql.avro.functions import from_avro

    framed = (F.length("value") > REGISTRY_HEADER) & (F.hex(F.substring("value", 1, 1)) == "00")
    body = F.when(framed, F.expr(f"substring(value, {REGISTRY_HEADER + 1})"))
    with_row = messages.withColumn("row", from_avro(body, schema, {"mode": "PERMISSIVE"}))
    # a broken body gives a row of nulls, a missing one no row
    filled = F.exists(F.array(*[F.col(f"row.{f}").isNotNull() for f in with_row.select("row.*").columns]), lambda x: x)
    return with_row.withColumn("error", F.when(F.col("value").isNull(), "tombstone").when(F.col("row").isNull() | ~filled, "avro"))


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where("error IS NULL").select("row.*")


def dead_letters(decoded: DataFrame) -> DataFrame:
    """What couldn't be read: where it lay, why, and its key and value in base64."""
    return decoded.where("error IS NOT NULL").select(*COORDINATES, "error", base64("key").alias("key_b64"), base64("value").alias("payload_b64"))


def to_messages(df: DataFrame, topic: str, key: Column, partition: Column | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows as messages of JSON, nulls included, for a batch or stream writer of the broker's format."""
    value = F.to_json(F.struct(*(fields or df.columns)), {"ignoreNullFields": "false"})
    columns = [F.lit(topic).alias("topic"), key.cast("string").alias("key"), value.alias("value")]
    return df.select(*columns, *([partition.cast("int").alias("partition")] if partition is not None else []))


def between_times(messages: DataFrame, since: datetime | Column, until: datetime | Column) -> DataFrame:
    """Of each partition the messages from the first one at ``since`` or later on, before the first one past ``until``.

    Times need not rise with offsets. Bounds are one row a partition, so they are broadcast.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    by = ["topic", "partition"]
    from_ = messages.where(F.col("timestamp") >= lit(since)).groupBy(*by).agg(F.min("offset").alias("__from"))
    begun = messages.join(F.broadcast(from_), by).where(F.col("offset") >= F.col("__from"))
    to = begun.where(F.col("timestamp") > lit(until)).groupBy(*by).agg(F.min("offset").alias("__to"))
    kept = begun.join(F.broadcast(to), by, "left").where(F.col("__to").isNull() | (F.col("offset") < F.col("__to")))
    return kept.select(*messages.columns)
