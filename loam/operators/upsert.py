"""Upserts into a table in partitions by a group and a bucket of the key: only partitions that changes fall in are rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.store import written

PARTS = ["part_group", "part_bucket"]
#: Partitions that a scan is told by name.
LISTED = 10_000


def placed(rows: DataFrame, key: str, group: str, buckets: int) -> DataFrame:
    """rows with their partition: the group (a site, say, so that a crawl of one leaves others alone), and a bucket of the key, so that a large group is cut."""
    names = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return rows.withColumn(PARTS[0], F.when(names == "", F.lit("-")).otherwise(F.concat(F.lit("g"), names))).withColumn(PARTS[1], F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, key: str, group: str, buckets: int) -> None:
    """Write rows, one for each key, as a partitioned table; a key always has the same group. A partition is one task's files."""
    _put(placed(rows, key, group, buckets), path, "errorifexists")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, without the partition columns."""
    return spark.read.parquet(path).drop(*PARTS)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, group: str, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Put merge(stored, changes) in place of the partitions that changes fall in; the others' files stay. The number of rewritten partitions.

    `merge` sees the stored rows of these partitions and all changes, and returns the table's columns. What it returns is first
    written apart, so that a job that is lost while partitions are replaced can be run again from `path`: merging the same changes
    twice has to give the same. Changes with keys in no partition yet make new ones; no changes rewrite nothing.
    """
    fresh = written(placed(changes, key, group, buckets), "changes")
    touched = fresh.select(*PARTS).distinct()
    n = touched.count()
    if not n:
        return 0
    stored = spark.read.parquet(path)
    merged = merge(affected(stored, touched, n).drop(*PARTS), fresh.drop(*PARTS)).select(*(c for c in stored.columns if c not in PARTS))
    _put(written(placed(merged, key, group, buckets), "merged"), path, "overwrite")
    return n


def affected(stored: DataFrame, touched: DataFrame, n: int) -> DataFrame:
    """The stored rows of the n touched partitions: up to LISTED are named in the scan, which then opens no other; more are met by a join."""
    if n > LISTED:
        return stored.join(touched, PARTS, "left_semi")
    names = [f"{r[0]}/{r[1]}" for r in touched.collect()]
    return stored.filter(F.concat_ws("/", *PARTS).isin(names))


def _put(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition(*PARTS).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)
