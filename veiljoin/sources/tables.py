"""Scans and sinks: parquet and CSV tables with an explicit id, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, id_col: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV table whose ``id_col`` becomes ``id``; without one, rows are numbered (see ``with_id``)."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumnRenamed(id_col, "id") if id_col else with_id(df)


def with_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Number rows 0, 1, 2, ...; write the result before using it twice.

    Each partition counts its rows and starts where those before it end, so no task sees all rows.
    """
    held = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_start"))
    out = held.join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).select(name, *df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A result table in long form: key, series, median, low and high quartile (from offsets to values)."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    series = [c for c in df.columns if c != key and f"{c} 25" in df.columns]
    rows = [
        F.struct(F.lit(s).alias("series"), F.col(f"`{s}`").alias("median"), (F.col(f"`{s}`") - F.col(f"`{s} 25`")).alias("low"),
                 (F.col(f"`{s}`") + F.col(f"`{s} 75`")).alias("high"))
        for s in series
    ]
    return df.select(F.col(f"`{key}`").alias(key), F.explode(F.array(*rows)).alias("r")).select(key, "r.*")
