"""Tables that outlive a query: written once to the folder that driver and executors share, found again by what they were made of."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; where it is unset, on one machine only, a new folder there."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="loam-store-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Of the files under paths: names, sizes and times of change, so another state of a table has another one. No file is opened."""
    found = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        found.append(tuple(files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()))
    return hashlib.sha256(repr((paths, found)).encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:  # no such path, or nothing in it
        return False
    return True


def built(spark: SparkSession, kind: str, key: str, build: Callable[[str], None]) -> str:
    """The folder of `kind` and `key`, made by `build` if it isn't there. `build` writes its folder `done` last."""
    path = f"{shared_dir(spark)}/loam-{kind}/{key}"
    if not exists(spark, f"{path}/done"):
        build(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finish(df: DataFrame, path: str) -> None:
    """Write the table that says that the others are whole."""
    df.write.mode("overwrite").parquet(f"{path}/done")
