"""Bandwidth heuristics for random Fourier features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.randomness import uniform
from ..sources.shared import keep
from .cells import sampled
from .features import exact_quantiles
from .prep import keep_ranked, numbered


def sampled_distances(df: DataFrame, id: str, vector: str, rows: int, seed: int) -> DataFrame:
    """Distances between all pairs of a sample of ``rows`` rows, so of a bounded number of pairs."""
    size = df.sparkSession.range(1).select(F.lit(rows).alias("k"))
    s = keep_ranked(df.select(id, vector), id, seed, size, tag="bandwidth")
    a, b = s.toDF("a", "x"), s.toDF("b", "y")
    gap = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda t, v: t + v * v)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.sqrt(gap).alias("distance"))


def median_distance(df: DataFrame, id: str, vector: str, rows: int = 1000, seed: int = 7) -> DataFrame:
    """The median pairwise distance of a sample of a stated size."""
    return sampled_distances(df, id, vector, rows, seed).agg(F.percentile("distance", F.lit(0.5)).alias("bandwidth"))


def all_distances(rows: DataFrame, group: str, largest: int, block_rows: int = 2048) -> DataFrame:
    """``group``, v, n: distances of all pairs of rows (group, id, x, n) within a group of at most ``largest`` rows, and how often.

    A row stands for ``n`` equal ones. Rows are packed in blocks; each pair of a group's blocks is a row, so no task holds more than two.
    """
    blocks = max(1, -(-largest // block_rows))
    held = rows.groupBy(group, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("n", "x")).alias("rows"))
    packed = held.select(
        group, "block", F.transform("rows", lambda r: r.n.cast("bigint")).alias("ns"), F.flatten(F.transform("rows", lambda r: r.x.cast("array<double>"))).alias("xs")
    )
    met = packed.join(packed.toDF(group, "other", "ns2", "xs2"), group).filter("block <= other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, p, q, ns, xs, ns2, xs2 in zip(*(batch[c] for c in (group, "block", "other", "ns", "xs", "ns2", "xs2"))):
                a, b = np.reshape(xs, (len(ns), -1)), np.reshape(xs2, (len(ns2), -1))
                for i in range(len(a)):
                    rest = slice(i + 1, None) if p == q else slice(None)
                    yield pd.DataFrame({group: g, "v": np.sqrt(((b[rest] - a[i]) ** 2).sum(axis=1)), "n": ns2[rest] * ns[i]})
                if p == q:
                    yield pd.DataFrame({group: g, "v": 0.0, "n": ns * (ns - 1) // 2})

    return met.mapInPandas(run, f"{group} {dict(rows.dtypes)[group]}, v double, n bigint").filter("n > 0")


def one_figure(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(np.mean(values)) if values else None,)], "bandwidth double")


class Meeting(NamedTuple):
    """Blocks of centred rows, each two of which meet once; ``error`` bounds that of a squared distance by products."""

    pairs: DataFrame
    error: float

    def squares(self, run: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, strip: int = 512) -> DataFrame:
        """``run(x, z, gaps)`` of strips of rows x against rows z with their squared distances, which NaN takes the place of for a pair counted elsewhere."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    x, z = np.reshape(r.xs, (r.n, -1)), np.reshape(r.zs, (r.m, -1))
                    own, other = (x * x).sum(1), (z * z).sum(1)
                    for at in range(0, len(x), strip):
                        gaps = x[at : at + strip] @ z.T
                        gaps *= -2
                        gaps += own[at : at + strip, None]
                        gaps += other
                        if r.block == r.other:
                            gaps[np.tri(len(gaps), len(z), at, bool)] = np.nan
                        yield run(x[at : at + strip], z, gaps)

        return self.pairs.mapInPandas(each, schema)


def meeting(df: DataFrame, vector: str, block_rows: int) -> tuple[Meeting, int, np.ndarray]:
    """The blocks of rows whose cells are all finite, the number of those rows, and a sample's distances."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    held = keep(df.select(x.alias("x")).filter(F.col("x").isNotNull() & finite), "distance-rows")
    n = held.count()
    centre = {r.i: r.m for r in held.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()}
    middle = [float(centre[i]) for i in range(len(centre))]
    moved = held.select(F.zip_with("x", F.lit(middle) if middle else F.array().cast("array<double>"), lambda v, m: v - m).alias("x"))
    largest = moved.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    blocks = max(1, -(-n // block_rows))
    numbered = moved.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"))
    packed = keep(numbered.agg(F.count(F.lit(1)).cast("int").alias("n"), F.flatten(F.collect_list("x")).alias("xs")), "distance-blocks")
    left = packed.select("*", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("other"))
    met = left.join(packed.toDF("other", "m", "zs"), "other").select("block", "other", "n", "m", "xs", "zs")
    return Meeting(met, 16 * (len(middle) + 8) * 2.0**-52 * largest), n, sampled(held, "x") if n else np.zeros(0)


def median_of_all(df: DataFrame, id: str, vector: str, bins: int = 65_536, few: int = 1_000_000, block_rows: int | None = None) -> DataFrame:
    """The median distance of all pairs of rows, exactly; their number grows with the square of the rows'. Null under two rows.

    Squared distances come from products of blocks, within a known error, and are counted in bins where they are made, so
    nothing is listed. The interval that holds the median narrows until it has ``few`` pairs, or is as narrow as the error;
    their distances are computed from the differences, and the pairs under it counted. What is found is right if it lies by more than the
    error inside: no pair on either side can belong on the other. Rows with a cell that isn't finite are left out.
    """
    held, n, sample = meeting(df, vector, block_rows or min(4096, max(256, -(-df.count() // 16))))
    total, error = n * (n - 1) // 2, held.error
    if not total:
        return one_figure(df.sparkSession, [])
    ranks, width = ((total - 1) // 2, total // 2), 0.06

    def counted(low: float, high: float) -> np.ndarray:
        def run(x: np.ndarray, z: np.ndarray, gaps: np.ndarray) -> pd.DataFrame:
            gaps -= low
            gaps *= bins / (high - low)
            gaps = gaps[~np.isnan(gaps)]
            found = np.bincount(np.clip(gaps + 1, 0, bins + 1).astype(np.int32), minlength=bins + 2)  # under, bins, over
            used = found.nonzero()[0]
            return pd.DataFrame({"bin": used, "n": found[used]})

        out = np.zeros(bins + 2, np.int64)
        for r in held.squares(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r.bin] = r.n
        return out

    def listed(low: float, high: float) -> tuple[int, list]:
        """How many pairs lie under ``low``, and the different distances of those within, with their numbers."""

        def run(x: np.ndarray, z: np.ndarray, gaps: np.ndarray) -> pd.DataFrame:
            i, j = ((gaps >= low) & (gaps <= high)).nonzero()
            parts = [np.sqrt(((x[i[k : k + 100_000]] - z[j[k : k + 100_000]]) ** 2).sum(1)) for k in range(0, len(i), 100_000)]
            v, n = np.unique(np.concatenate(parts) if parts else np.zeros(0), return_counts=True)
            return pd.DataFrame({"v": np.r_[-1.0, v], "n": np.r_[(gaps < low).sum(), n]})

        rows = sorted(held.squares(run, "v double, n bigint").groupBy("v").agg(F.sum("n").alias("n")).collect())
        return rows[0].n, rows[1:]

    reach = lambda w: np.quantile(sample, [0.5 - w, 0.5 + w]) ** 2 if w < 0.5 and len(sample) else np.array([-error, 16 * error * 2.0**52 + error])
    low, high = reach(width) + np.array([-1, 1]) * 4 * error + np.array([0, 1e-300])
    while True:
        upto, edges = np.cumsum(counted(low, high)), np.linspace(low, high, bins + 1)
        if ranks[0] < upto[0] or ranks[1] >= upto[-2]:  # the sample misled
            width *= 3
            low, high = reach(width) + np.array([-1, 1]) * 4 * error + np.array([0, 1e-300])
            continue
        i, j = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
        step, inside = (high - low) / bins, upto[j] - upto[i - 1]
        low, high = edges[i - 1], edges[j]
        if inside <= few or step <= 8 * error + 1e-12 * abs(high) + 1e-290:
            break
        low, high = low - 4 * error, high + 4 * error
    margin = 4 * error + 1e-12 * abs(high) + 1e-300
    while True:
        low, high = low - margin, high + margin
        under, values = listed(low, high)
        upto = under + np.cumsum([r.n for r in values])
        at = [int(np.searchsorted(upto, r, side="right")) for r in ranks]
        if under <= ranks[0] and at[1] < len(values) and all(low + error <= values[k].v ** 2 <= high - error for k in at):
            return one_figure(df.sparkSession, [float(np.mean([values[k].v for k in at]))])
        margin *= 8


def mean_of_medians(df: DataFrame, id: str, vector: str, repeats: int = 10, rows: int = 10_000, seed: int = 7) -> DataFrame:
    """The mean of the exact medians of all pairwise distances of several samples with replacement, of ``rows`` rows each.

    A draw is a place in a fixed order of the rows. A row that is drawn several times is one with a count, so as many pairs are
    compared as there are of different rows; copies are 0 apart.
    """
    spark, size = df.sparkSession, df.count()
    if not size:
        return one_figure(spark, [])
    table = numbered(df.select(F.col(id).alias("id"), F.col(vector).alias("x")), "id", seed)
    place = F.floor(uniform(F.col("id"), "bootstrap", seed) * size).cast("bigint")
    draws = spark.range(repeats * rows).groupBy(F.floor(F.col("id") / rows).cast("int").alias("i"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    found = exact_quantiles(all_distances(draws.join(table, "place").select("i", "id", "x", "n"), "i", min(rows, size)), [0.5])
    return one_figure(spark, [v[0] for v in found.values()])


def variance_bandwidth(df: DataFrame, vector: str) -> DataFrame:
    """sqrt(columns * population variance of all cells)."""
    cells = df.select(F.size(vector).alias("p"), F.explode(vector).alias("v"))
    return cells.agg(F.sqrt(F.max("p") * F.var_pop(F.col("v").cast("double"))).alias("bandwidth"))
