"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a temporary folder, a cluster's an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_veiljoin_tables", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._veiljoin_tables = tempfile.mkdtemp(prefix="veiljoin-tables-")
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, and outlives the executors that computed it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
