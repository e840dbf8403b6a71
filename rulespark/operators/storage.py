"""Intermediate tables on storage that the driver and all executors share, which cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset on one machine a temporary folder, removed at exit; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = getattr(spark, "_rulespark_tables", None)
        if local is None:
            local = spark._rulespark_tables = tempfile.mkdtemp(prefix="rulespark-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
