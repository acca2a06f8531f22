"""Membership and value sketches: noisy sums of signed rows by bucket, and their decoding.

Without ``buckets`` every id has a bucket of its own. Then sketch and decoding are one expression
on the known side, and neither a shuffle by bucket nor a table of buckets is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randomness import bucket, geometric, laplace, sign


def _all_buckets(spark: SparkSession, buckets: int, sums: DataFrame) -> DataFrame:
    """Every bucket, also those no id falls in: leaving them out would tell that they are empty."""
    return spark.range(buckets).withColumnRenamed("id", "bucket").join(sums, "bucket", "left")


def member_sketch(private: DataFrame, id: str, eps: float, buckets: int, seed: int) -> DataFrame:
    """bucket, value: signs of private ids plus two-sided geometric noise."""
    sums = private.select(bucket(F.col(id), "memb", seed, buckets).alias("bucket"), sign(F.col(id), "memb", seed).alias("s"))
    out = _all_buckets(private.sparkSession, buckets, sums.groupBy("bucket").agg(F.sum("s").alias("s")))
    return out.select("bucket", (F.coalesce("s", F.lit(0.0)) + geometric(F.col("bucket"), "memb", seed, eps)).alias("value"))


def value_sketch(private: DataFrame, id: str, column: str, eps: float, sens: float, buckets: int, seed: int) -> DataFrame:
    """bucket, value: signed values plus Laplace noise of scale sens / eps."""
    tag = f"val.{column}"
    sums = private.select(bucket(F.col(id), tag, seed, buckets).alias("bucket"), (sign(F.col(id), tag, seed) * F.col(column)).alias("s"))
    out = _all_buckets(private.sparkSession, buckets, sums.groupBy("bucket").agg(F.sum("s").alias("s")))
    return out.select("bucket", (F.coalesce("s", F.lit(0.0)) + laplace(F.col("bucket"), tag, seed, sens / eps)).alias("value"))


def decode(known: DataFrame, id: str, sketch: DataFrame, tag: str, buckets: int, seed: int, name: str) -> DataFrame:
    """Each known id's estimate: its sign times its bucket's value."""
    at = known.withColumn("bucket", bucket(F.col(id), tag, seed, buckets))
    out = at.join(sketch.withColumnRenamed("value", "_value"), "bucket")
    return out.withColumn(name, sign(F.col(id), tag, seed) * F.col("_value")).select(*known.columns, name)


def own_membership(id: Column, present: Column, eps: float, seed: int, *parts: Column) -> Column:
    """Decoded membership where each id has a bucket of its own: presence plus signed noise."""
    return F.when(present, F.lit(1.0)).otherwise(F.lit(0.0)) + sign(id, "memb", seed, *parts) * geometric(id, "memb", seed, eps, *parts)


def own_value(id: Column, value: Column, column: str, eps: float, sens: float, seed: int) -> Column:
    tag = f"val.{column}"
    return F.coalesce(value, F.lit(0.0)) + sign(id, tag, seed) * laplace(id, tag, seed, sens / eps)
