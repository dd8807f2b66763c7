"""The rate limiter on a stream against the batch query, over shuffled micro-batches."""

from __future__ import annotations

import datetime as dt
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loam.operators.analytics import rate_limited
from loam.streaming import limits

BASE = dt.datetime(2024, 3, 1, 12)
SCHEMA = "user_id long, event_id long, ts timestamp_ntz"


def requests(seed: int):
    """Four minutes' requests in random order; user 0 makes most."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.6 else rng.randint(1, 5), n, BASE + dt.timedelta(milliseconds=rng.randrange(240_000))) for n in range(400)]


def put(path, batches):
    """One file for each micro-batch, in order."""
    path.mkdir()
    for n, rows in enumerate(batches):
        columns = list(zip(*rows, strict=True))
        pq.write_table(pa.table({"user_id": pa.array(columns[0], "int64"), "event_id": pa.array(columns[1], "int64"), "ts": pa.array(columns[2], pa.timestamp("us"))}), path / f"{n:03}.parquet")


def follow(spark, tmp_path, batches, limit, late):
    put(tmp_path / "in", batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run = limits.to_end(limits.verdicts(stream, limit, late=late), str(tmp_path / "out"), str(tmp_path / "state"))
    return run, spark.read.parquet(str(tmp_path / "out"))


def rows_of(df):
    return {(r["user_id"], r["window_start"]): (r["allowed"], r["rejected"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_and_forgets(spark, tmp_path, seed):
    rows = requests(seed)
    cut = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    after = [[(-1, 10_000 + n, BASE + dt.timedelta(hours=1 + n))] for n in range(3)]  # three hours on, nothing of the first minutes is held
    run, decided = follow(spark, tmp_path, cut + after, 3, "10 minutes")
    batch = spark.createDataFrame(rows, SCHEMA)
    mine = decided.filter("user_id >= 0")
    assert mine.count() == len(rows)
    assert rows_of(limits.counted(mine)) == rows_of(rate_limited(batch, 3))
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if json.loads(p.json)["stateOperators"]]
    assert max(held) > 10 and held[-1] <= 4  # the last request's own window, its timer with it


def test_requests_beyond_the_lateness_are_dropped_and_others_count(spark, tmp_path):
    at = lambda minutes: BASE + dt.timedelta(minutes=minutes)
    batches = [[(1, 1, at(0)), (1, 9, None)], [(1, 2, at(8))], [(1, 3, at(0.5))], [(1, 4, at(30))], [(1, 5, at(31))], [(1, 6, at(0.6))]]
    _, decided = follow(spark, tmp_path, batches, 1, "10 minutes")
    assert {r["event_id"]: r["allowed"] for r in decided.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}
