"""Partitioned upserts: the rows of a plain one, and files that stay where nothing changed."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from loam.operators import upsert
from loam.operators.analytics import upserted

ROWS = "url string, site string, text string"


def merge(old, changes):
    return upserted(old, changes, "url")


def files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.select("url", "site", "text").collect()), key=repr)


def made(spark, path, n=400):
    rows = [(f"u{i}", random.Random(i).choice(["a", "b", "c", "hot", "hot", "hot"]), f"t{i}") for i in range(n)]
    upsert.create(spark.createDataFrame(rows, ROWS), path, "url", "site", 8)
    return {r[0]: r for r in rows}


def test_rounds_equal_a_plain_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    now = made(spark, path)
    for n in range(3):
        rng = random.Random(n)
        changes = {u: (u, now[u][1] if u in now else "new", f"{u} of round {n}") for u in (f"u{rng.randrange(500)}" for _ in range(25))}
        upsert.upsert(spark, path, spark.createDataFrame(list(changes.values()), ROWS), "url", "site", 8, merge)
        now |= changes
        assert rows_of(upsert.opened(spark, path)) == sorted(now.values())


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = made(spark, path)
    before = files(path)
    some = next(r for r in rows.values() if r[1] == "a")
    n = upsert.upsert(spark, path, spark.createDataFrame([(some[0], "a", "other")], ROWS), "url", "site", 8, merge)
    after = files(path)
    gone = {f.rsplit("/", 1)[0] for f in before if after.get(f) != before[f]}
    assert n == 1 == len(gone) and gone.pop().startswith("part_group=ga/") and len({f.rsplit("/", 1)[0] for f in after}) == len({f.rsplit("/", 1)[0] for f in before})


@pytest.mark.parametrize("listed", [0, upsert.LISTED])
def test_a_scan_opens_touched_partitions_only(spark, tmp_path, monkeypatch, listed):
    path = str(tmp_path / "t")
    rows = made(spark, path)
    monkeypatch.setattr(upsert, "LISTED", listed)
    touched = spark.createDataFrame([("ga", 0), ("ghot", 3)], "part_group string, part_bucket int")
    old = upsert.affected(spark.read.parquet(path), touched, 2)
    found = {tuple(r) for r in old.select("url", *upsert.PARTS).collect()}
    placed = upsert.placed(spark.createDataFrame(list(rows.values()), ROWS), "url", "site", 8)
    assert found == {tuple(r) for r in placed.filter("(part_group = 'ga' AND part_bucket = 0) OR (part_group = 'ghot' AND part_bucket = 3)").select("url", *upsert.PARTS).collect()}
    if listed:
        assert "PartitionFilters: [concat_ws" in old._jdf.queryExecution().toString() and old.select(upsert.F.input_file_name()).distinct().count() <= 2


def test_no_changes_null_groups_and_repeated_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.create(spark.createDataFrame([("u0", None, "x"), ("u1", "", None), ("u2", "-", "z")], ROWS), path, "url", "site", 2)
    before = files(path)
    assert upsert.upsert(spark, path, spark.createDataFrame([], ROWS), "url", "site", 2, merge) == 0 and files(path) == before
    change = spark.createDataFrame([("u0", None, "y"), ("u9", None, None)], ROWS)
    for _ in range(2):  # as a job does that is run again
        upsert.upsert(spark, path, change, "url", "site", 2, merge)
        assert rows_of(upsert.opened(spark, path)) == sorted([("u0", None, "y"), ("u1", "", None), ("u2", "-", "z"), ("u9", None, None)], key=repr)


def test_a_table_is_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    made(spark, path, 5)
    with pytest.raises(Exception, match="(?i)exist"):
        made(spark, path, 5)
