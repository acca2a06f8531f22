"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small

#: Terms of the inverted distribution: more than 12 * sqrt(rate) + 24 from the rate, either way, the tails are below 1e-15.
TAIL = (12.0, 24.0)
#: Sources with rates up to this one have short tables, which are broadcast; rows of others are at most this part of the result.
COMMON_RATE = 1000.0
#: A row's copies are made in steps of at most this many.
STEP = 10_000


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts only: 48 bits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def poisson_table(rates: DataFrame) -> DataFrame:
    """source, least, cdf: the distribution function of each rate at least, least + 1, ... as an array; before that it is 0.

    The number of terms grows with the root of the rate. Beyond 20 factorials are taken by Stirling's series, its
    large parts cancelled beforehand, so that terms of large rates are exact too.
    """
    spread = TAIL[0] * F.sqrt("rate") + TAIL[1]
    least = F.greatest(F.floor(F.col("rate") - spread), F.lit(0)).cast("bigint")
    last = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + spread)).otherwise(0).cast("bigint")
    rows = rates.withColumn("least", least).withColumn("k", F.explode(F.sequence("least", last)))
    k = F.greatest(F.col("k").cast("double"), F.lit(20.0))
    off = (F.col("rate") - k) / k
    few = -F.col("rate") + F.col("k") * F.ln("rate") - F.ln(F.factorial(F.least(F.col("k"), F.lit(20)).cast("int")).cast("double"))
    many = k * (F.log1p(off) - off) - F.ln(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k) - 1 / (1260 * k * k * k * k * k)
    term = F.when(F.col("rate") <= 0, 1.0).when(F.col("k") <= 20, F.exp(few)).otherwise(F.exp(many))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("term", term).withColumn("cdf", F.sum("term").over(up_to))
    held = told.groupBy("source", "least").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("cdf"))
    return held.select("source", "least", F.transform("cdf", lambda x: x.cdf).alias("cdf"))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source, rows, rate: the mean number of copies of each of a source's rows."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        counts = counts.withColumn("weight", F.coalesce(given[F.coalesce("source", F.lit(""))], F.lit(0.0)))
    whole = counts.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    share = F.col("weight") / F.lit(float(whole.w or 1.0))
    return counts.select("source", "rows", (share * F.lit(float(whole.n or 0) * epochs) / F.col("rows")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    shuffle: bool = True,
) -> DataFrame:
    """Replicate rows so that sources meet their weights; append copy and mix_key and shuffle globally.

    A row's number of copies is the Poisson quantile, for the source's mean rate, of a number
    that depends on the seed, the source and the id alone; so a rerun after a lost executor gives
    the same rows. Rates follow from row counts over the whole input: the expected output is
    ``epochs`` times its rows, split by weight. ``weights`` None weighs all sources alike; sources
    that are missing from it get weight 0. Rows are ordered by ``mix_key``, a hash of id and copy,
    over a range partitioning. Copies of rows of frequent sources are made in steps, in all tasks.

    A null source is a source of its own, named by the empty string in ``weights``. Rows that
    repeat an id and a source get equal counts and keys. An empty table gives an empty result.
    Columns named copy and mix_key are replaced.
    """
    rest = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rates = save(source_rates(docs, source_col, weights, epochs), "mixing-rates")
    u = unit(seed, F.col("source"), F.col("id"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(picked: DataFrame) -> DataFrame:
        """Rows of the sources picked that have copies, with the first copy of each step."""
        found = poisson_table(picked).select(F.col("source").alias("mix_source"), F.col("least").alias("mix_least"), F.col("cdf").alias("mix_cdf"))
        return (
            docs.select(F.struct(*rest).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
            .join(small(found, 10_000), F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn("n", F.col("mix_least") + F.size(F.filter("mix_cdf", lambda c: c <= u)))
            .filter("n > 0")
            .select("row", "id", "n")
            .withColumn("from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(STEP).cast("bigint"))))
        )

    steps = counted(rates.filter(F.col("rate") <= COMMON_RATE))
    often = rates.filter(F.col("rate") > COMMON_RATE)
    if not often.isEmpty():
        # few rows of very many copies: their steps go to all tasks
        steps = steps.unionByName(counted(often).repartition(tasks, "id", "from"))
    out = (
        steps.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + (STEP - 1), F.col("n")))))
        .withColumn("copy", F.col("copy").cast("int"))
        .withColumn("mix_key", unit(seed + 1, F.col("id"), F.col("copy")))
        .select("row.*", "copy", "mix_key")
    )
    return out.orderBy("mix_key", id_col) if shuffle else out
