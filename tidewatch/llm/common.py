"""Helpers shared by the training-data operators: scratch tables, samples, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of applications whose deletion is registered.
_USED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it.

    It is read from ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would not be seen by other executors.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"/tmp/tidewatch-scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of the application that goes when the driver exits."""
    app = f"{scratch_root(spark)}/tidewatch-{spark.sparkContext.applicationId}"
    if app not in _USED:
        _USED.add(app)
        atexit.register(forget, spark, app)
    return f"{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame that ``written`` gave, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        forget(df.sparkSession, name)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder through Hadoop's file system API, if the driver's JVM still runs."""
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of about so many rows and bytes at most, as rows may hold whole texts.

    Spark itself bounds the bytes of a batch.
    """
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def give_back() -> None:
    """Give what the worker's allocators hold unused back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def given_back(it: Iterator) -> Iterator:
    """The same items; what the worker's allocators hold unused goes back to the machine at the end.

    Workers are used again by later stages and sit beside those that run then.
    """
    try:
        yield from it
    finally:
        give_back()


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """The frame, after bounding the rows of its session's Arrow batches, as rows here hold whole texts.

    Batches of 10,000 texts took several hundred MB more of an executor. The setting is read when a
    query runs, so it has to stay in the session; a smaller one is left as it is.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_unsigned_crc(df: DataFrame, name: str, id_col: str, mod: int) -> DataFrame:
    """Add crc32(id as text) mod ``mod`` as a column; null for a null id."""
    return df.withColumn(name, F.crc32(F.col(id_col).cast("string").cast("binary")) % mod)


def hash_sample(df: DataFrame, bound: int, *cols: str, seed: int = 17) -> DataFrame:
    """About ``bound`` rows at most, drawn by a hash of ``cols``; all rows when there are fewer.

    The same rows come out on every run, whatever the partitioning.
    """
    n = df.count()
    if n <= bound:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(span)) < int(span * 0.95 * bound / n))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node.

    Alternating large-star and small-star steps; each round's edges are written to the
    shared folder, so that a lost executor costs one round at most. Nodes without an edge
    to another node are absent from the result.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = (
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now = written(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
