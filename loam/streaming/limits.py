"""A rate limiter on a stream of requests: a verdict for each, a count per user and window that a timer lets go of.

Needs the RocksDB state store provider, which `to_end` sets for its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, window_second long, event_id long, place long, allowed boolean"


class Limiter(StatefulProcessor):
    """Per user and window: requests so far, until the watermark has passed the window's end."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.seen.get()  # each call to the store is a trip to the JVM
        n = known[0] if known else 0
        if not n:
            self.handle.registerTimer((int(key[1]) + self.seconds) * 1000)
        for batch in rows:
            places = range(n + 1, n + len(batch) + 1)
            n += len(batch)
            yield pd.DataFrame({"user_id": key[0], "window_second": key[1], "event_id": batch["event_id"].to_numpy(), "place": places, "allowed": [p <= self.limit for p in places]})
        self.seen.update((n,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame(columns=["user_id", "window_second", "event_id", "place", "allowed"])

    def close(self) -> None:
        pass


def verdicts(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, window_start, event_id, place, allowed) of a stream requests(user_id, event_id, ts): the first `limit` of a user's window are allowed.

    Places are in the order of arrival, so how many are allowed doesn't depend on it. A request that is late by at most `late` counts in its own
    window; one later still is dropped, as its window's count is gone. A request without a time is in no window and gets no verdict. A window is a key of its own, so a busy user is spread over tasks.
    """
    timed = requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    second = F.unix_seconds("at")
    keyed = timed.filter("at IS NOT NULL").withColumn("window_second", second - F.pmod(second, F.lit(seconds))).groupBy("user_id", "window_second")
    found = keyed.transformWithStateInPandas(statefulProcessor=Limiter(limit, seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return found.select("user_id", F.timestamp_seconds("window_second").alias("window_start"), "event_id", "place", "allowed")


def counted(decided: DataFrame) -> DataFrame:
    """(user_id, window_start, allowed, rejected) of a table of verdicts."""
    named = decided.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("allowed").alias("_allowed"))
    return named.groupBy("user_id", "window_start").agg(F.count_if(F.col("_allowed")).alias("allowed"), F.count_if(~F.col("_allowed")).alias("rejected"))


def to_end(decided: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the verdicts of what a stream has by now to Parquet files, with the state store that they need; run again, it goes on from there."""
    conf = decided.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        run = decided.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        return run
    finally:
        conf.set(PROVIDER, before) if before is not None else conf.unset(PROVIDER)
