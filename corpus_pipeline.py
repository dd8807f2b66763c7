"""A training corpus from raw documents: five stages, each a DataFrame to a DataFrame.

1. quality classifier: documents that it rejects go
2. near duplicates: one document of each class stays
3. suffix dedup: byte strings that repeat elsewhere are cut out of the texts
4. decontamination: documents that hold a benchmark passage go
5. SentencePiece: the texts left are encoded, decoded and verified

Every stage sees all that its predecessor kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm.common import release, stored, table
from loam.llm.decontaminate import drop_contaminated
from loam.llm.near_dedup import keep_one
from loam.llm.quality import drop_rejected
from loam.llm.sentencepiece_codec import encode_report
from loam.llm.suffix_dedup import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: No stage but the fourth can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release()
    return docs
