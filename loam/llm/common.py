"""What several operators share: table loading, the shared folder, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.blocks import on_release, release  # noqa: F401  (release is for the pipeline)

# Words are runs of ASCII digits, ASCII letters and everything from U+0080 on.
WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work on single rows: dealt to as many tasks as run at once if it has fewer files."""
    found = table(spark, sf_dir, name).select(*columns)
    tasks = spark.sparkContext.defaultParallelism
    return found if len(found.inputFiles()) >= tasks else found.repartition(tasks)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; where it is unset, on one machine only, a new folder there."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="loam-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, any executor may die."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Keep df on the executors' disks, as it is read several times. The lineage stays: what a lost
    executor held is made again. Let go by release(), or by spark.catalog.clearCache(). Only for frames
    near stored ones: plans of kept frames on kept frames grow with every level.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    on_release(held.unpersist)
    return held


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df, stored or cheap to make again, for broadcast when it has at most max_rows rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words of a text; null gives an empty array."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAPS)
    return F.filter(parts, lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node of each connected component.

    Rounds of large-star and small-star: every node hands its neighbours over to the smallest one it
    sees. Each round is two grouped minima and two joins on disk-backed tables; stars only are left when
    a round changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def star(pairs: DataFrame) -> DataFrame:
        """Of (centre, other): every other node, and the centre, linked to the smallest node among them."""
        lowest = pairs.groupBy("centre").agg(F.min(F.least("centre", "other")).alias("low"))
        return pairs.join(lowest, "centre")

    seal = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = seal(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("centre"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("centre"), F.col("a").alias("other")))
        large = star(both).filter("other > centre").select(F.col("other").alias("a"), F.col("low").alias("b")).distinct()
        small = star(large.select(F.col("a").alias("centre"), F.col("b").alias("other")))
        merged = small.select(F.col("centre").alias("a"), F.col("low").alias("b")).unionByName(small.select(F.col("other").alias("a"), F.col("low").alias("b")))
        edges = stored(merged.filter("a <> b").distinct(), "edges")
        after = seal(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def lean_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes, besides the rows, of the batches that Spark reads and hands to Python: texts may be long.

    A query runs after the function that made it returns, so the session has its own settings again at the next release().
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.parquet.columnarReaderBatchSize": "512"}
    before = {name: spark.conf.get(name) for name in wanted}
    if before != wanted:
        on_release(lambda: [spark.conf.set(name, value) for name, value in before.items()])
        for name, value in wanted.items():
            spark.conf.set(name, value)


@contextlib.contextmanager
def lean(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """The bounds of lean_batches for what runs inside; the session's own settings come back after it."""
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, (str(size), "512"), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Return what a task freed to the system: Python workers outlive their tasks, and others need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)
