"""Exact neighbours and exact medians of distances that leave out pairs by the triangle inequality.

Rows are dealt to the nearest of some pivots, and each pivot's rows to blocks by their distance to it. A block is
then known by its pivot and a range of distances, which bounds the distance to any point and to any other block.
The bounds are a small table; blocks are rows of bounded size, so any number of rows share one pivot safely.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: Pivots at most, rings a pivot's rows are counted in, and rows a block.
PIVOTS, RINGS, BLOCK_ROWS = 512, 256, 1024
#: Beyond this share of all pairs pruning doesn't pay: rows are compared with all others, in large blocks.
ALL_PAIRS = 0.25
#: Bounds are widened by this share, as distances are rounded.
SLACK = 1e-7


class Cells(NamedTuple):
    """``rows``: block, ids, labels, xs (packed). By block: pivot's number, least and greatest distance to it, rows."""

    rows: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that each point can have to the rows of each block."""
        d = distances(points, self.pivots)[:, self.pivot]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) * (1 - SLACK), (d + self.high) * (1 + SLACK)

    def between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs of blocks."""
        d = distances(self.pivots, self.pivots)[self.pivot[a], self.pivot[b]]
        least = np.maximum.reduce([d - self.high[a] - self.high[b], self.low[a] - d - self.high[b], self.low[b] - d - self.high[a], np.zeros(len(a))])
        return least * (1 - SLACK), (d + self.high[a] + self.high[b]) * (1 + SLACK)


def distances(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """By differences, a column at a time: exact for equal rows, and the same in any block."""
    gaps = np.zeros((len(x), len(z)))
    for j in range(x.shape[1]):
        gaps += (x[:, j, None] - z[None, :, j]) ** 2
    return np.sqrt(gaps)


def cells(df: DataFrame, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> Cells:
    """Cells of the rows (id, label, x) with a vector; the pivots are the rows with the smallest hashes.

    About four times as many pivots as the root of the number of rows unless told, at most ``PIVOTS``.
    """
    held = keep(df.filter("x is not null").select("id", F.col("label").cast("double").alias("label"), F.col("x").cast("array<double>").alias("x")), "cell-rows")
    n = held.count()
    wanted = min(PIVOTS, max(1, int(4 * n**0.5))) if pivots is None else pivots
    some = held.select("x", F.xxhash64("x", "id").alias("h")).orderBy("h", "x").limit(wanted).collect()
    different = sorted({tuple(r.x) for r in some})
    at = np.array(different, float).reshape(len(different), len(different[0]) if different else 0)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(np.stack(batch["x"].to_list()), at)
                best = d.argmin(1)
                yield batch.assign(pivot=best, r=d[np.arange(len(d)), best])

    kind = dict(held.dtypes)["id"]
    dealt = keep(held.mapInPandas(near, f"id {kind}, label double, x array<double>, pivot int, r double"), "cell-pivots")
    widest = {r.pivot: r.r for r in dealt.groupBy("pivot").agg(F.max("r").alias("r")).collect()}
    scale = F.element_at(F.create_map(*[c for p, r in widest.items() for c in (F.lit(p), F.lit(float(r) or 1.0))]), F.col("pivot")) if widest else F.lit(1.0)
    dealt = dealt.withColumn("ring", F.least(F.floor(F.col("r") / scale * RINGS), F.lit(RINGS - 1)).cast("int"))
    rings = sorted(dealt.groupBy("pivot", "ring").count().collect())
    plan, block, size, last = [], -1, 0, None
    for pivot, ring, count in rings:  # neighbouring rings share a block, crowded rings are several
        parts = -(-count // block_rows)
        if pivot != last or size + count > block_rows:
            block, size, last = block + 1, 0, pivot
        plan.append((pivot, ring, block, parts))
        block, size = block + parts - 1, size + count if parts == 1 else block_rows
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(plan, "pivot int, ring int, first int, parts int"))  # at most PIVOTS x RINGS rows
    number = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    placed = dealt.join(table, ["pivot", "ring"]).withColumn("block", number)
    packed = placed.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("r").alias("low"), F.max("r").alias("high"), F.array_sort(F.collect_list(F.struct("id", "label", "x"))).alias("rows"))
    column = lambda c: F.transform("rows", lambda r: r[c])
    packed = keep(packed.select("block", "pivot", "low", "high", column("id").alias("ids"), column("label").alias("labels"), F.flatten(column("x")).alias("xs")), "cell-blocks")
    told = sorted(packed.select("block", "pivot", "low", "high", F.size("ids").alias("n")).collect())
    # blocks that no row's hash chose have none, so numbers are made consecutive by place in the table
    places = spark.createDataFrame([(r.block, i) for i, r in enumerate(told)], "block int, place int")
    rows = packed.join(places, "block").select(F.col("place").alias("block"), "ids", "labels", "xs")
    return Cells(rows, at, *(np.array([r[i] for r in told], kind) for i, kind in ((1, int), (2, float), (3, float), (4, int))))


# ---------------------------------------------------------------- nearest neighbours


def nearest_of(gaps: np.ndarray, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rounded gap and column of the ``k`` smallest gaps of each row, of equal ones the first columns. Only gaps near the k-th are rounded and sorted."""
    if gaps.shape[1] > k:
        row, column = (gaps <= np.partition(gaps, k - 1, axis=1)[:, k - 1 : k] + 2 * 10.0**-digits).nonzero()
    else:
        row, column = (np.indices(gaps.shape).reshape(2, -1))
    return nearest_rows(row, gaps[row, column].round(digits), column, column, k)[:3]


def nearest_rows(row: np.ndarray, d: np.ndarray, near: np.ndarray, vote: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row the ``k`` entries with the smallest (d, near)."""
    order = np.lexsort((near, d, row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], *(v[order][first] for v in (d, near, vote))


def packed(df: DataFrame, rows: int, block: str) -> tuple[DataFrame, int]:
    """Blocks of about ``rows`` rows as one row each (block, ids, labels, xs), and how many there are."""
    blocks = max(1, -(-df.count() // rows))
    held = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(block)).agg(F.collect_list(F.struct("id", "label", "x")).alias("rows"))
    column = lambda c: F.transform("rows", lambda r: r[c])
    xs = F.flatten(F.transform("rows", lambda r: r.x.cast("array<double>")))
    return held.select(block, column("id").alias("ids"), column("label").alias("labels"), xs.alias("xs")), blocks


def all_neighbours(train: DataFrame, test: DataFrame, k: int = 5, train_rows: int = 4096, test_rows: int = 1024, fan_in: int = 256) -> DataFrame:
    """id, ns: each test row's k nearest training rows (squared distance, id, label) over all pairs; of equal distances the smaller ids.

    Blocks of test rows meet all blocks of training rows; each meeting gives every test row its k
    nearest of the block. Those merge ``fan_in`` blocks at a time, so no group holds more than
    fan_in * k candidates, however many training rows there are.
    """
    rows, blocks = packed(train, train_rows, "block")
    asked = packed(test.withColumn("label", F.lit(0.0)), test_rows, "part")[0].select(
        F.col("ids").alias("asked"), F.col("xs").alias("ys"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, asked, ys, ids, labels, xs in zip(*(batch[c] for c in ("block", "asked", "ys", "ids", "labels", "xs"))):
                order = np.argsort(ids, kind="stable")
                y, x = np.reshape(ys, (len(asked), -1)), np.reshape(xs, (len(ids), -1))[order]
                gaps = np.zeros((len(y), len(x)))
                for j in range(x.shape[1]):
                    gaps += (y[:, j, None] - x[None, :, j]) ** 2
                row, d, near = nearest_of(gaps, k)
                yield pd.DataFrame({"id": np.asarray(asked)[row], "block": block, "d": d, "n_id": np.asarray(ids)[order][near], "n_label": np.asarray(labels, float)[order][near]})

    kind, n_kind = dict(test.dtypes)["id"], dict(train.dtypes)["id"]
    found = asked.join(rows, "block").mapInPandas(meet, f"id {kind}, block bigint, d double, n_id {n_kind}, n_label double")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("d", "n_id", "n_label"))), 1, k).alias("ns")
    while blocks > fan_in:
        blocks = -(-blocks // fan_in)
        found = found.groupBy("id", F.pmod("block", F.lit(blocks)).alias("block")).agg(nearest).select("id", "block", F.explode("ns").alias("n")).select("id", "block", "n.*")
    return found.groupBy("id").agg(nearest)


def visits(held: Cells, test: DataFrame, k: int, first: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """block, id, x: the blocks a row has to see. At first those nearest by their bounds that hold ``k`` rows; then, with
    the ``k``-th distance found in them (id, kth), all others that could hold a nearer one, or one as near. ``counts``: only block and n, how often."""
    model, again = held._replace(rows=None), first is not None

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 4_000_000 // len(model.count))
        for batch in (whole.iloc[i : i + step] for whole in batches for i in range(0, len(whole), step)):
            least, most = model.bounds(np.stack(batch["x"].to_list()))
            order = np.lexsort((most, least))
            seen = np.take_along_axis(model.count[None, :].repeat(len(batch), 0), order, 1).cumsum(1)
            nearest = np.zeros(least.shape, bool)
            np.put_along_axis(nearest, order, np.pad(seen < k, ((0, 0), (1, 0)), constant_values=True)[:, : len(model.count)], 1)
            chosen = ~nearest & (least <= batch["kth"].to_numpy(float)[:, None] * (1 + SLACK) + 1e-9) if again else nearest
            if counts:
                yield pd.DataFrame({"block": np.arange(len(model.count), dtype=np.int32), "n": chosen.sum(0)})
                continue
            i, block = chosen.nonzero()
            yield pd.DataFrame({"block": block.astype(np.int32), "id": batch["id"].to_numpy()[i], "x": batch["x"].to_numpy()[i]})

    kind = dict(test.dtypes)["id"]
    rows = test.select("id", F.col("x").cast("array<double>").alias("x"))
    rows = rows if first is None else rows.join(first.select("id", "kth"), "id")
    return rows.mapInPandas(found, "block int, n bigint" if counts else f"block int, id {kind}, x array<double>")


def meet(held: Cells, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """id, ns: the ``k`` nearest rows (d, id, label) of the blocks that a row visits; visitors of a block come in ``parts`` groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                y, x = np.reshape(r.ys, (len(r.asked), -1)), np.reshape(r.xs, (len(r.ids), -1))
                gaps = (distances(y, x) ** 2).round(9)
                near = np.argsort(gaps, axis=1, kind="stable")[:, :k]  # blocks are in the order of ids
                n = near.shape[1]
                yield pd.DataFrame({
                    "id": np.repeat(r.asked, n), "d": np.take_along_axis(gaps, near, 1).ravel(),
                    "n_id": np.asarray(r.ids)[near].ravel(), "n_label": np.asarray(r.labels, float)[near].ravel(),
                })

    groups = asked.groupBy("block", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    packed = groups.select("block", F.transform("rows", lambda r: r["id"]).alias("asked"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("ys"))
    kinds = dict(asked.dtypes)["id"], dict(held.rows.dtypes)["ids"][len("array<") : -1]
    found = packed.join(held.rows, "block").mapInPandas(run, f"id {kinds[0]}, d double, n_id {kinds[1]}, n_label double")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "n_id", "n_label"))), 1, k).alias("ns"))


def pruned_neighbours(train: DataFrame, test: DataFrame, k: int = 5, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """id, ns: each test row's ``k`` nearest training rows (squared distance, id, label), of equal ones the smaller ids; and how many pairs were compared.

    Two rounds: the nearest blocks that hold ``k`` rows give a distance that no better row exceeds; then only blocks that
    come as near are seen. If those make more than ``ALL_PAIRS`` of all pairs, as on data without clusters, each row is compared with all
    others instead. Test ids must be unique. Rows without a vector have no neighbours.
    """
    held = cells(train, pivots, block_rows)
    asked = keep(test.filter("x is not null").select("id", "x"), "asked")
    parts, sizes = max(1, -(-asked.count() // block_rows)), np.array(held.count, int).tolist()
    if not sizes:
        return asked.select("id", F.array().cast("array<struct<d:double,n_id:bigint,n_label:double>>").alias("ns")), 0
    one = keep(visits(held, asked, k), "visits")
    near = keep(meet(held, one, k, parts), "nearest")
    kth = near.select("id", F.when(F.size("ns") < k, F.lit(float("inf"))).otherwise(F.sqrt(F.element_at("ns", -1)["d"])).alias("kth"))
    first = {r.block: r["count"] for r in one.groupBy("block").count().collect()}
    again = {r.block: r.n for r in visits(held, asked, k, kth, counts=True).groupBy("block").agg(F.sum("n").alias("n")).collect()}
    whole, some = sum(sizes) * asked.count(), sum(sizes[b] * n for seen in (first, again) for b, n in seen.items())
    if some > ALL_PAIRS * whole:
        return all_neighbours(train.filter("x is not null"), asked, k), whole
    two = keep(visits(held, asked, k, kth), "visits")
    more = meet(held, two, k, parts).select("id", F.col("ns").alias("other"))
    merged = near.join(more, "id", "left").select("id", F.slice(F.array_sort(F.concat("ns", F.coalesce("other", F.array()))), 1, k).alias("ns"))
    return merged, some


def pruned_votes(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """``test`` with ``predicted``: the majority label of the nearest rows, 1 where votes are equal, as in ``models.nearest_votes``."""
    votes = F.aggregate("ns", F.lit(0.0), lambda s, n: s + n["n_label"])
    best = pruned_neighbours(train, test, k)[0].select("id", F.when(F.size("ns") > 0, F.when(votes >= 0, 1.0).otherwise(-1.0)).alias("predicted"))
    return test.join(best, "id", "left")


# ---------------------------------------------------------------- the median of all distances


class Pairs(NamedTuple):
    """Pairs of blocks that straddle an interval, and how many pairs of rows lie below it."""

    a: np.ndarray
    b: np.ndarray
    below: int


def straddling(held: Cells, pairs: Pairs, low: float, high: float) -> Pairs:
    least, most = held.between(pairs.a, pairs.b)
    n = np.where(pairs.a == pairs.b, held.count[pairs.a] * (held.count[pairs.a] - 1) // 2, held.count[pairs.a] * held.count[pairs.b])
    under, over = most < low, least > high
    on = ~(under | over)
    return Pairs(pairs.a[on], pairs.b[on], pairs.below + int(n[under].sum()))


def block_pairs(held: Cells, pairs: Pairs) -> DataFrame:
    """Two blocks a row, dealt out by pair."""
    spark = held.rows.sparkSession
    listed = spark.createDataFrame(pd.DataFrame({"a": pairs.a.astype(np.int32), "b": pairs.b.astype(np.int32)}), "a int, b int")
    left = held.rows.select(F.col("block").alias("a"), F.col("xs").alias("xa"), F.size("ids").alias("na"))
    return listed.join(left, "a").join(left.toDF("b", "xb", "nb"), "b")


def pair_distances(r) -> np.ndarray:
    x, z = np.reshape(r.xa, (r.na, -1)), np.reshape(r.xb, (r.nb, -1))
    d = distances(x, z)
    return d[np.triu_indices(len(d), 1)] if r.a == r.b else d.ravel()


def counted(held: Cells, pairs: Pairs, low: float, high: float, bins: int) -> np.ndarray:
    """How many distances of the pairs of blocks are under ``low``, in each of the bins of [low, high], and over it."""
    edges = np.linspace(low, high, bins + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(bins + 2, np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                d = pair_distances(r)
                total += np.bincount(np.searchsorted(edges, d, side="left"), minlength=bins + 2)
        yield pd.DataFrame({"bin": np.arange(bins + 2), "n": total})

    found = block_pairs(held, pairs).mapInPandas(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(bins + 2, np.int64)
    for r in found:
        out[r.bin] = r.n
    return out


def median_by_cells(df: DataFrame, id: str, vector: str, pivots: int | None = None, block_rows: int = BLOCK_ROWS, bins: int = 4096, few: int = 200_000) -> tuple[float | None, int]:
    """The exact median distance of all pairs of rows, and how many distances were computed. None under two rows.

    Distances are counted in bins where they are computed, never listed; pairs of blocks that lie wholly under or over
    the bin that holds the median are counted by their sizes and drop out. At most ``few`` distances, those of the last
    bin, come to the driver. The pairs of blocks are a table on the driver: blocks must be large enough for that.
    """
    held = cells(df.select(F.col(id).alias("id"), F.lit(0.0).alias("label"), F.col(vector).alias("x")), pivots, block_rows)
    n = int(held.count.sum())
    total = n * (n - 1) // 2
    if not total:
        return None, 0
    a, b = np.triu_indices(len(held.count))
    ranks, evaluated = ((total - 1) // 2, total // 2), 0
    size = lambda p: int(np.where(p.a == p.b, held.count[p.a] * (held.count[p.a] - 1) // 2, held.count[p.a] * held.count[p.b]).sum())
    sample, width = sampled(df, vector), 0.06
    longest = float(held.between(a, b)[1].max())
    low, high = around(sample, width, longest)
    pairs = straddling(held, Pairs(a, b, 0), low, high)
    while True:
        evaluated += size(pairs)
        counts = counted(held, pairs, low, high, bins)
        edges, upto = np.linspace(low, high, bins + 1), pairs.below + np.cumsum(counts)
        if ranks[0] < upto[0] or ranks[1] >= upto[-2]:  # the sample misled
            width *= 2
            low, high = around(sample, width, longest)
            pairs = straddling(held, Pairs(a, b, 0), low, high)
            continue
        i, j = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
        inside, narrow = int(upto[j] - upto[i - 1]), (edges[i - 1], edges[j])
        if inside <= few or narrow[1] - narrow[0] <= 1e-12 * high or narrow == (low, high):
            break
        (low, high), pairs = narrow, straddling(held, pairs, *narrow)
    low, high = narrow
    last = straddling(held, pairs, low, high)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                d = pair_distances(r)
                v, n = np.unique(d[(d > low) & (d <= high)], return_counts=True)
                yield pd.DataFrame({"v": v, "n": n})

    evaluated += size(last)
    values = sorted(block_pairs(held, last).mapInPandas(run, "v double, n bigint").groupBy("v").agg(F.sum("n").alias("n")).collect())
    at, found = int(upto[i - 1]), []
    cumulative = at + np.cumsum([r.n for r in values])
    for r in ranks:
        found.append(values[int(np.searchsorted(cumulative, r, side="right"))].v)
    return float(np.mean(found)), evaluated


def sampled(df: DataFrame, vector: str, rows: int = 512) -> np.ndarray:
    """Distances between the ``rows`` rows with the smallest hashes; they only say where to look first."""
    x = F.col(vector).cast("array<double>")
    some = df.filter(F.col(vector).isNotNull()).select(x.alias("x"), F.xxhash64(x, F.lit(1)).alias("h")).orderBy("h", "x").limit(rows).collect()
    points = np.array([r.x for r in some], float)
    return distances(points, points)[np.triu_indices(len(points), 1)]


def around(sample: np.ndarray, width: float, longest: float) -> tuple[float, float]:
    """The sample's quantiles on both sides of its median; open below, so that distances of 0 are inside; everything from a half on."""
    if width >= 0.5 or not len(sample):
        return -1e-300, longest
    low, high = np.quantile(sample, [0.5 - width, 0.5 + width])
    return float(low * (1 - SLACK) if low > 0 else -1e-300), float(max(high * (1 + SLACK), longest * 1e-9))
