"""Comparing a large table with every row of a stated set; frames that several parts of a plan read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the set that go to every task at once.
BLOCK = 10_000


def against(large: DataFrame, stated: DataFrame, key: str, condition: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Each row of large with each row of stated (that meets a condition).

    The set is counted. Up to `block` rows are broadcast; a larger set is cut by a hash of its key into
    blocks of about that size, and the large table is read once for each.
    """
    parts = max(1, -(-stated.count() // block))
    cut = [stated.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) if parts > 1 else stated for i in range(parts)]
    pairs = [large.join(F.broadcast(part), condition, "inner") if condition is not None else large.crossJoin(F.broadcast(part)) for part in cut]
    return reduce(DataFrame.unionByName, pairs)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast when it has at most max_rows rows; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df for work on single rows: dealt to as many tasks as run at once, if it comes from fewer files than that.

    A file with one row group is one task, whatever its size. Tables of many files are left as they are.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= tasks else df.repartition(tasks)


_undo: list[Callable[[], object]] = []


def on_release(undo: Callable[[], object]) -> None:
    """Have `undo` called when what the present query has set up is let go of."""
    _undo.append(undo)


def kept(df: DataFrame) -> DataFrame:
    """df held by the executors, in memory or on disk, as several parts of a plan read it; its lineage stays."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    on_release(held.unpersist)
    return held


def release() -> None:
    """Let go of what is kept and put settings back, the last first. A result that still needs them is computed again."""
    while _undo:
        _undo.pop()()
