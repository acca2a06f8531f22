"""One-hot encoding, Gram matrix and principal components of tables with any number of columns, as sparse rows.

A row is (id, indices, values). The Gram matrix is tiles as rows; components come from products X'(XQ), each one pass
over the rows, so no p by p matrix is ever held. The driver has p x d numbers at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep
from .blocks import HELD_BYTES, merge_sums
from .prep import numbered

#: Columns a tile of the Gram matrix, and columns a message of partial products.
TILE = 512


def sparse_one_hot(df: DataFrame, id: str, columns: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, indices, values) with a 1 for the category of each column; the categories (index, column, category); their number.

    Any number of categories: they are found and numbered by Spark, in the order of a draw. Null is no category. Ids must be unique.
    """
    cells = df.select(F.col(id).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns])).alias("c"))
    cells = cells.select("id", "c.*")
    known = cells.filter("category is not null").select("column", "category").distinct().withColumn("name", F.concat_ws("=", "column", "category"))
    known = keep(numbered(known, "name", seed, "index").select(F.col("index").cast("int").alias("index"), "column", "category"), "categories")
    met = cells.join(known, ["column", "category"], "left").groupBy("id").agg(F.array_sort(F.collect_set("index")).alias("indices"))
    return met.select("id", "indices", F.transform("indices", lambda i: F.lit(1.0)).alias("values")), known, known.count()


def sparse(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Sparse rows of dense vectors; rows without one are left out."""
    cells = F.transform(vector, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v")))
    held = df.filter(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.filter(cells, lambda c: c["v"] != 0).alias("cells"))
    return held.select("id", F.transform("cells", lambda c: c["i"]).alias("indices"), F.transform("cells", lambda c: c["v"]).alias("values"))


def coordinates(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of a batch's cells."""
    sizes = batch["indices"].map(len).to_numpy()
    if not sizes.sum():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.repeat(np.arange(len(batch)), sizes), np.concatenate(batch["indices"].to_list()).astype(int), np.concatenate(batch["values"].to_list()).astype(float)


def gram_tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """ti, tj, numbers: the tile of X'X with columns ti * tile on by tj * tile on, ti <= tj, row after row; tiles of zeros are left out.

    For rows with many cells; ``sparse_gram`` is for those with few. A task multiplies what its rows have in two tiles and hands sums on when they outgrow ``HELD_BYTES``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        piece = TaskContext.get().partitionId() << 20
        for batch in (whole.iloc[i : i + 1024] for whole in batches for i in range(0, len(whole), 1024)):
            row, column, value = coordinates(batch)
            dense = {}
            for t in np.unique(column // tile).tolist():
                own = column // tile == t
                used, place = np.unique(row[own], return_inverse=True)
                block = np.zeros((len(used), tile))
                np.add.at(block, (place, column[own] % tile), value[own])
                dense[t] = used, block
            for a in dense:
                for b in dense:
                    if a <= b:
                        both, i, j = np.intersect1d(dense[a][0], dense[b][0], assume_unique=True, return_indices=True)
                        if len(both):
                            product = dense[a][1][i].T @ dense[b][1][j]
                            held[a, b] = held[a, b] + product if (a, b) in held else product
                            if len(held) * tile * tile * 8 > HELD_BYTES:
                                yield told(held, piece)
                                held, piece = {}, piece + 1
        if held:
            yield told(held, piece)

    def told(held: dict[tuple[int, int], np.ndarray], piece: int) -> pd.DataFrame:
        return pd.DataFrame([(a, b, piece, product.ravel()) for (a, b), product in held.items()], columns=["ti", "tj", "piece", "numbers"])

    partial = rows.select("indices", "values").mapInPandas(run, "ti bigint, tj bigint, piece bigint, numbers array<double>")
    return merge_sums(partial, ("ti", "tj"), lambda part, n: (*part, n.tolist()), "ti bigint, tj bigint, numbers array<double>")


def sparse_gram(rows: DataFrame) -> DataFrame:
    """i, j, value of X'X for i <= j where rows have cells in both columns: for rows of few cells, whose products are summed before they are shuffled."""
    cells = F.arrays_zip("indices", "values")
    product = lambda a, b: F.struct(a["indices"].alias("i"), b["indices"].alias("j"), (a["values"] * b["values"]).alias("v"))
    pairs = F.transform(cells, lambda a: F.transform(F.filter(cells, lambda b: b["indices"] >= a["indices"]), lambda b: product(a, b)))
    return rows.select(F.explode(F.flatten(pairs)).alias("p")).groupBy("p.i", "p.j").agg(F.sum("p.v").alias("value"))


def gram_entries(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """i, j, value of the cells of X'X that aren't 0, for i <= j."""
    cells = tiles.select("ti", "tj", F.posexplode("numbers").alias("at", "value")).filter("value <> 0")
    i, j = F.col("ti") * tile + F.floor(F.col("at") / tile), F.col("tj") * tile + F.col("at") % tile
    return cells.select(i.cast("int").alias("i"), j.cast("int").alias("j"), "value").filter("i <= j")


def times(rows: DataFrame, q: np.ndarray, mean: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """X'(XQ) and the number of rows; with ``mean``, of rows less their mean. Tasks send p x d sums in chunks of columns."""
    width, d = q.shape
    spread = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((width, d)), 0
        for batch in batches:
            row, column, value = coordinates(batch)
            y = np.zeros((len(batch), d))
            np.add.at(y, row, value[:, None] * spread.value[column])
            np.add.at(total, column, value[:, None] * y[row])
            n += len(batch)
        piece, chunks = TaskContext.get().partitionId(), range(0, width, TILE)
        used = [c for c in chunks if total[c : c + TILE].any()]
        parts = [(c // TILE, piece, total[c : c + TILE].ravel()) for c in used] + [(-1, piece, np.array([float(n)]))]
        yield pd.DataFrame(parts, columns=["chunk", "piece", "numbers"])

    partial = rows.select("indices", "values").mapInPandas(run, "chunk bigint, piece bigint, numbers array<double>")
    out, n = np.zeros((width, d)), 0
    for r in merge_sums(partial, ("chunk",), lambda part, v: (*part, v.tolist()), "chunk bigint, numbers array<double>").collect():
        if r.chunk < 0:
            n = int(r.numbers[0])
        else:
            out[r.chunk * TILE : (r.chunk + 1) * TILE] = np.reshape(r.numbers, (-1, d))
    spread.unpersist()
    if mean is not None:
        out -= n * np.outer(mean, mean @ q)
    return out, n


def means(rows: DataFrame, width: int) -> np.ndarray:
    """Of all columns, zeros counted."""
    n, out = rows.count(), np.zeros(width)
    for r in rows.select(F.explode(F.arrays_zip("indices", "values")).alias("c")).groupBy("c.indices").agg(F.sum("c.values").alias("s")).collect():
        out[r.indices] = r.s / n
    return out


def principal(rows: DataFrame, width: int, d: int, centred: bool = False, iterations: int = 60, tolerance: float = 1e-9, extra: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``d`` leading eigenvectors of X'X (of the covariance's sums if ``centred``) as columns, and their eigenvalues.

    Subspace iteration with ``extra`` more directions; ends when the leading directions move by less than ``tolerance``. An
    empty table gives zeros as eigenvalues.
    """
    rows = keep(rows.select("indices", "values"), "sparse-rows")
    mean = means(rows, width) if centred else None
    size = min(width, d + extra)
    q, before = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0], None
    values = np.zeros(size)
    for _ in range(iterations):
        product, n = times(rows, q, mean)
        if not n or not np.abs(product).max() > 0:
            break
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        lead = (q @ turn)[:, ::-1][:, :d]
        if before is not None and np.abs(lead - before @ (before.T @ lead)).max() < tolerance:
            return lead, values[::-1][:d]
        before, q = lead, np.linalg.qr(product)[0]
    return (q[:, :d] if before is None else before), values[::-1][:d]


# ---------------------------------------------------------------- components of more columns than the driver holds

#: Up to so many columns the driver holds the directions; beyond, only the cells of the ``HUBS`` columns with most cells.
DRIVER_COLUMNS, HUBS = 200_000, 1024


def random_rows(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Numbers in (-1, 1) that depend on index, place and seed alone."""
    mixed = (index.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))).astype(float) / 2.0**63 - 1


def matrix_sums(df: DataFrame, found: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """``found(batch)`` added up over all batches: one array, of bounded size, a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in (b for b in batches if len(b)):
            total = found(batch) if total is None else total + found(batch)
        if total is not None:
            yield pd.DataFrame({"piece": [TaskContext.get().partitionId()], "numbers": [total.ravel()]})

    parts = sorted(df.mapInPandas(run, "piece bigint, numbers array<double>").collect())
    return np.sum([p.numbers for p in parts], axis=0) if parts else np.zeros(0)


def components(rows: DataFrame, width: int, d: int, centred: bool = False, iterations: int = 60, tolerance: float = 1e-9, extra: int = 8, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """index, lead (``d`` numbers): the leading directions as in ``principal`` for rows of few cells and any number of columns; and their eigenvalues.

    Beyond ``DRIVER_COLUMNS`` the Gram matrix's cells are summed once. Those between two hubs, and the hubs' directions, are on the
    driver; every other column is a row with its cells against the hubs and its own part of the directions, so a product is one pass, and
    cells between two other columns, if there are any, are a join a pass.
    """
    spark = rows.sparkSession
    if width <= DRIVER_COLUMNS:
        vectors, values = principal(rows, width, d, centred, iterations, tolerance, extra, seed)
        return spark.createDataFrame([(i, vectors[i].tolist()) for i in range(width)], "index int, lead array<double>"), values
    rows, size = keep(rows.select("indices", "values"), "sparse-rows"), min(width, d + extra)
    n = rows.count()
    cells = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("c"))
    sums = keep(cells.groupBy(F.col("c.indices").alias("index")).agg((F.sum("c.values") / n * int(centred)).alias("mean"), F.count(F.lit(1)).alias("n")), "column-sums")
    top = sums.orderBy(F.desc("n"), "index").limit(HUBS).collect()
    hub_index, hub_mean = np.array([r["index"] for r in top], int), np.array([r["mean"] for r in top], float)
    place = F.broadcast(spark.createDataFrame([(int(i), p) for p, i in enumerate(hub_index)], "index int, place int"))
    gram = sparse_gram(rows).join(place.toDF("i", "pi"), "i", "left").join(place.toDF("j", "pj"), "j", "left")
    gram = keep(gram, "gram-cells")
    inner = np.zeros((len(hub_index), len(hub_index)))
    for r in gram.filter("pi is not null and pj is not null").collect():
        inner[r.pi, r.pj] = inner[r.pj, r.pi] = r.value
    light = F.when(F.col("pi").isNull(), F.col("i")).otherwise(F.col("j")).alias("index")
    mixed = gram.filter("(pi is null) <> (pj is null)").select(light, F.struct(F.coalesce("pi", "pj").alias("p"), F.col("value").alias("v")).alias("c"))
    own = gram.filter("pi is null and pj is null and i = j").select(F.col("i").alias("index"), F.col("value").alias("diagonal"))
    lists = mixed.groupBy("index").agg(F.array_sort(F.collect_list("c")).alias("c"))
    base = sums.join(place, "index", "left_anti").join(own, "index", "left").join(lists, "index", "left")
    base = base.select("index", "mean", F.coalesce("diagonal", F.lit(0.0)).alias("diagonal"), F.transform(F.coalesce("c", F.array()), lambda c: c["p"]).alias("hubs"), F.transform(F.coalesce("c", F.array()), lambda c: c["v"]).alias("weights"))
    pairs = gram.filter("pi is null and pj is null and i <> j").select("i", "j", "value")
    pairs = keep(pairs.unionByName(pairs.toDF("j", "i", "value")), "light-pairs") if not pairs.isEmpty() else None

    def square(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # row, hub and weight of a batch's cells
        sizes = batch["hubs"].map(len).to_numpy()
        joined = lambda c: np.concatenate(batch[c].to_list()) if sizes.sum() else np.zeros(0)
        return np.repeat(np.arange(len(batch)), sizes), joined("hubs").astype(int), joined("weights")

    stacked = lambda batch, c: np.stack(batch[c].to_list()).astype(float)
    schema = "index int, mean double, diagonal double, hubs array<int>, weights array<double>, q array<double>, lead array<double>, moved double"

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b for b in batches if len(b)):
            yield b.assign(q=list(random_rows(b["index"].to_numpy(), size, seed)), lead=list(np.zeros((len(b), d))), moved=np.inf)

    state, hubs, values, before = keep(base.mapInPandas(begun, schema), "directions"), random_rows(hub_index, size, seed), np.zeros(size), None
    for _ in range(iterations):
        def across(b: pd.DataFrame) -> np.ndarray:
            row, hub, weight = square(b)
            q, out = stacked(b, "q"), np.zeros((len(hub_index) + 1, size))
            np.add.at(out, hub, weight[:, None] * q[row])
            out[-1] = b["mean"].to_numpy() @ q
            return out

        whole = matrix_sums(state, across)
        whole = whole.reshape(-1, size) if len(whole) else np.zeros((len(hub_index) + 1, size))
        means = whole[-1] + hub_mean @ hubs
        product = inner @ hubs + whole[:-1] - n * np.outer(hub_mean, means)
        seen = state
        if pairs is not None:
            q = state.select(F.col("index").alias("j"), "q")
            met = pairs.join(q, "j").groupBy("i").agg(F.array(*[F.sum(F.col("value") * F.get("q", F.lit(k))) for k in range(size)]).alias("more"))
            seen = keep(state.join(met.withColumnRenamed("i", "index"), "index", "left"), "directions")

        def times_gram(b: pd.DataFrame, hubs=hubs, means=means) -> tuple[np.ndarray, np.ndarray]:
            row, hub, weight = square(b)
            q = stacked(b, "q")
            z = b["diagonal"].to_numpy()[:, None] * q - n * np.outer(b["mean"].to_numpy(), means)
            np.add.at(z, row, weight[:, None] * hubs[hub])
            if "more" in b:
                some = b["more"].notna().to_numpy()
                if some.any():
                    z[some] += stacked(b[some], "more")
            return q, z

        def inner_products(b: pd.DataFrame) -> np.ndarray:
            q, z = times_gram(b)
            return np.concatenate([q.T @ z, q.T @ q, z.T @ z, stacked(b, "lead").T @ q])

        told = matrix_sums(seen, inner_products)
        told = told.reshape(-1, size) if len(told) else np.zeros((3 * size + d, size))
        both = told + np.concatenate([hubs.T @ product, hubs.T @ hubs, product.T @ product, (np.zeros((d, len(hubs))) if before is None else before.T) @ hubs])
        bend, length, next_length, turned = np.split(both, [size, 2 * size, 3 * size])
        if not n or not next_length.diagonal().max() > 0:
            break
        root = whitener(length)
        values, turn = np.linalg.eigh(root.T @ ((bend + bend.T) / 2) @ root)
        turn = (root @ turn)[:, ::-1][:, :d]
        values, back, scale = values[::-1], turned @ turn, whitener(next_length)
        scale = np.pad(scale, ((0, 0), (0, size - scale.shape[1])))

        def step(batches: Iterator[pd.DataFrame], turn=turn, back=back, scale=scale, times_gram=times_gram) -> Iterator[pd.DataFrame]:
            for b in (b for b in batches if len(b)):
                q, z = times_gram(b)
                lead = q @ turn
                moved = np.abs(lead - stacked(b, "lead") @ back).max(1)
                yield b.assign(q=list(z @ scale), lead=list(lead), moved=moved)[["index", "mean", "diagonal", "hubs", "weights", "q", "lead", "moved"]]

        state, first = keep(seen.mapInPandas(step, schema), "directions"), before is None
        lead = hubs @ turn
        far = max(state.agg(F.max("moved")).first()[0] or 0.0, 0.0 if first else np.abs(lead - before @ back).max(initial=0.0))
        hubs, before = product @ scale, lead
        if not first and far < tolerance:
            break
    lead = np.zeros((len(hub_index), d)) if before is None else before
    known = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(hub_index, lead)], "index int, lead array<double>")
    return state.select("index", "lead").unionByName(known), values[:d]


def whitener(lengths: np.ndarray) -> np.ndarray:
    """Columns that make directions with the inner products ``lengths`` orthonormal; directions of length 0 drop out."""
    scale = 1 / np.sqrt(np.maximum(lengths.diagonal(), 1e-300))
    own, turn = np.linalg.eigh(lengths * np.outer(scale, scale))
    held = own > 1e-13 * max(own.max(), 1e-300)
    return scale[:, None] * turn[:, held] / np.sqrt(own[held])
