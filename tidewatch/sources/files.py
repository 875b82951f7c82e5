"""Files that go in and out: example sets, recordings of a stream, review sheets, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import base64, csv_safe

EXAMPLE = "post_id string, text string, label string"
RECORD = "topic string, partition int, offset long, timestamp_ms long, key_b64 string, value_b64 string"


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """One JSON object a line, by a fixed schema; a line that isn't one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_recording(messages: DataFrame, path: str) -> None:
    """Messages (topic, partition, offset, timestamp, key, value) as JSON lines with base64 payloads."""
    messages.select(
        "topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp_ms"),
        base64("key").alias("key_b64"), base64("value").alias("value_b64"),
    ).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages of a recording, and the lines that aren't any with what is wrong."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    m = F.from_json("value", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = raw.withColumn("m", m)
    payload = lambda c: F.try_to_binary(F.col(f"m.{c}"), F.lit("base64"))
    fault = (
        F.when(F.col("m").isNull() | F.col("m._bad").isNotNull(), "json")
        .when(F.col("m.topic").isNull() | F.col("m.offset").isNull() | F.col("m.timestamp_ms").isNull(), "field")
        .when(F.col("m.value_b64").isNotNull() & payload("value_b64").isNull(), "value")
        .when(F.col("m.key_b64").isNotNull() & payload("key_b64").isNull(), "key")
    )
    told = parsed.withColumn("fault", fault)
    good = told.where("fault IS NULL").select(
        "m.topic", "m.partition", "m.offset", F.timestamp_millis("m.timestamp_ms").alias("timestamp"),
        payload("key_b64").alias("key"), payload("value_b64").alias("value"),
    )
    return good, told.where("fault IS NOT NULL").select("file", "fault", "value")


def write_review(df: DataFrame, path: str) -> None:
    """A sheet for review: text columns can't be taken for formulas."""
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def markdown(title: str, df: DataFrame, columns: Sequence[str], most: int = 200) -> str:
    """A small result as a Markdown table; longer ones are an error, as a report isn't a place for them."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"
