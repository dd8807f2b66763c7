"""Makes the library importable by Python workers of a session that was started without it on its path."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loam.operators.blocks import release

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless PYTHONPATH has it for every worker."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    staging = Path(tempfile.mkdtemp(prefix="loam-ship-"))
    shutil.copytree(ROOT / "loam", staging / "tree" / "loam", ignore=shutil.ignore_patterns("__pycache__"))
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", staging / "tree")
    context.addPyFile(shutil.make_archive(str(staging / "loam"), "zip", staging / "tree"))
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        release()  # what the query before it kept
        return query(spark, sf_dir)

    return run
