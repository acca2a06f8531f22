"""A membership sketch over a stream of ids: a stateful sum by bucket. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import bucket, geometric, sign


def stream_member_sketch(stream: DataFrame, id: str, time: str, buckets: int, seed: int, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """window, bucket, value without noise: the signed sum of each window's distinct ids.

    Rows that repeat an id within the window's watermark count once.
    """
    seen = stream.withWatermark(time, late).withColumn("w", F.window(time, window)).dropDuplicates([id, "w"])
    return seen.groupBy("w", bucket(F.col(id), "memb", seed, buckets).alias("bucket")).agg(F.sum(sign(F.col(id), "memb", seed)).alias("value"))


def add_noise(sums: DataFrame, eps: float, buckets: int, seed: int) -> DataFrame:
    """Every window's full set of buckets, with noise, once its sums are final."""
    windows = sums.select(F.col("w.start").alias("start")).distinct()
    every = windows.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    noise = geometric(F.concat_ws(":", F.col("start").cast("bigint"), "bucket"), "memb", seed, eps)
    held = sums.select(F.col("w.start").alias("start"), "bucket", "value")
    return every.join(held, ["start", "bucket"], "left").select("start", "bucket", (F.coalesce("value", F.lit(0.0)) + noise).alias("value"))
