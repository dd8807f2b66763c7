"""What must stay bounded, or as the session had it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import common, decontaminate, quality
from loam.operators.blocks import release


def test_contaminated_rows_go_whatever_columns_are_called(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(i, text, i, i + 1, "r", "s") for i, text in enumerate([f"x {item} y", "clean text", None, item])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k1 long, _k2 long, _r1 string, k1 string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {rows[1], rows[2]}


def test_a_labelled_id_of_many_texts_sends_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), set(y.tolist()))) or quality.Network(np.zeros(1), np.ones(1), [], constant=0.5))
    texts = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 1_000).cast("string")).alias("text"))
    others = spark.range(5).select((F.col("id") + 100).alias("doc_id"), F.lit("other text").alias("text"))
    labels = spark.createDataFrame([(7, 1), *((100 + i, 0) for i in range(5))], "doc_id long, quality int")
    quality.train(texts.unionByName(others), labels)
    assert seen == [(50, seen[0][1])]


def test_settings_and_kept_frames_go_with_the_query(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    release()
    before = spark.conf.get(name)
    common.lean_batches(spark)
    held = common.kept(spark.range(5))
    held.count()
    assert spark.conf.get(name) == "512" and held.is_cached
    release()
    assert spark.conf.get(name) == before and not held.is_cached


def test_no_folder_of_its_own_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
