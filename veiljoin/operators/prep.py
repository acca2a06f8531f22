"""Cleaning, splitting and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randomness import uniform

#: Bins of the distributed rank: only the bin that holds the cut, a millionth of the rows, is sorted.
BINS = 1 << 20
#: One row a group is broadcast up to so many groups.
BROADCAST_GROUPS = 100_000


def universe(*tables: DataFrame, id: str = "id") -> DataFrame:
    """All ids of the tables, once."""
    return reduce(DataFrame.union, [t.select(id) for t in tables]).distinct()


def keep_classes(df: DataFrame, column: str, remap: dict) -> DataFrame:
    """Rows whose class is a key of ``remap``, with its value instead."""
    pairs = [F.lit(x) for pair in remap.items() for x in pair]
    return df.filter(F.col(column).isin(*remap)).withColumn(column, F.create_map(*pairs)[F.col(column)])


def collapse_classes(column: Column, positive: object) -> Column:
    """1 for one class, -1 for all others."""
    return F.when(column == positive, F.lit(1)).otherwise(F.lit(-1))


def centre(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """Columns less their mean in ``by`` (default: in ``df`` itself): one aggregate row, joined to all."""
    means = (by if by is not None else df).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(
        *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def one_hot(df: DataFrame, column: str, categories: list | None = None, limit: int = 10_000) -> DataFrame:
    """A 0/1 column for each category, named column_category. Categories are found if not given, up to ``limit``."""
    if categories is None:
        found = df.select(column).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{column} has more than {limit} categories")
        categories = sorted(r[0] for r in found if r[0] is not None)
    flags = [F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{column}_{str(c).lower() if isinstance(c, bool) else c}") for c in categories]
    return df.select(*[c for c in df.columns if c != column], *flags)


def one_hot_types(df: DataFrame, types: tuple[str, ...] = ("string", "boolean"), keep: tuple[str, ...] = (), limit: int = 10_000) -> DataFrame:
    """One-hot columns for all columns of these types but those to ``keep``; the others stay as they are."""
    out = df
    for name, kind in df.dtypes:
        if kind in types and name not in keep:
            out = one_hot(out, name, limit=limit)
    return out


def hash_split(df: DataFrame, id: str, fraction: float, seed: int) -> Column:
    """True for the training part."""
    return uniform(F.col(id), "split", seed) < fraction


def keep_ranked(df: DataFrame, id: str, seed: int, keep: DataFrame, group: str | None = None, tag: str = "sample") -> DataFrame:
    """Of each group the ``k`` rows with the smallest draw, exactly, without a sort of all rows.

    ``keep`` has a row (group, k), or one row (k). Draws are uniform, so bins of them are even: bins
    under the cut stay whole, and only the bin with the cut is ranked. Rows meet one row a group, the cut, by a
    broadcast where ``keep`` has at most ``BROADCAST_GROUPS`` rows, so they aren't shuffled.
    """
    few = group is None or keep.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    spread = F.broadcast if few else (lambda one: one)
    g = F.col(group) if group else F.lit(0)
    rows = df.withColumns({"_u": uniform(F.col(id), tag, seed), "_g": g}).withColumn("_bin", F.floor(F.col("_u") * BINS))
    counts = rows.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = keep.select((F.col(group) if group else F.lit(0)).alias("_g"), F.col("k").cast("bigint").alias("_k"))
    bins = counts.withColumn("_below", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).join(spread(wanted), "_g").filter("_below < _k")
    cuts = bins.groupBy("_g").agg(F.max("_bin").alias("_cut"), F.max_by("_below", "_bin").alias("_below"), F.max("_k").alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_g", "_bin").orderBy("_u", id))
    held = rows.join(spread(cuts), "_g")
    whole = held.filter("_bin < _cut")
    cut = held.filter("_bin = _cut").withColumn("_r", rank).filter("_below + _r <= _k").drop("_r")
    return whole.unionByName(cut).select(*df.columns)


def numbered(df: DataFrame, id: str, seed: int, name: str = "place") -> DataFrame:
    """Rows with their place, from 0 on, in the order of a draw of their id, which any plan and partitioning gives alike; no task sorts more than a bin."""
    rows = df.withColumn("_u", uniform(F.col(id), "place", seed)).withColumn("_bin", F.floor(F.col("_u") * BINS))
    up_to = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_u", id))
    return rows.join(starts, "_bin").withColumn(name, F.col("_start") + rank - 1).select(name, *df.columns)


def subsample(df: DataFrame, id: str, fraction: float, seed: int, of: DataFrame | None = None) -> DataFrame:
    """``fraction`` of the row count of ``of`` (default: of ``df``), exactly, without replacement."""
    size = (of if of is not None else df).agg(F.round(F.count(F.lit(1)) * fraction).alias("k"))
    return keep_ranked(df, id, seed, size)


def biased_subsample(df: DataFrame, id: str, label: str, whole: object, seed: int, divisor: int = 4, of: str = "other") -> DataFrame:
    """All rows of one class and some of the others: 1/divisor of the others ("other") or of all rows ("all")."""
    n = F.count(F.when(F.col(label) != F.lit(whole), 1)) if of == "other" else F.count(F.lit(1))
    rest = df.filter(F.col(label) != F.lit(whole))
    some = keep_ranked(rest, id, seed, df.agg(F.floor(n / divisor).alias("k")))
    return df.filter(F.col(label) == F.lit(whole)).unionByName(some)
