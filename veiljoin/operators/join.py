"""Private joins of three kinds: real labels, selected signs, created features.

All return lazy DataFrames on the known side's ids. Without buckets, membership is an expression
on one left join by id, whose strategy Spark chooses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.budget import Ledger
from ..functions.randomness import geometric, laplace, sign
from . import response, sketch
from .features import ROOT2, clip
from .selection import row_mask, top_columns


def joined(known: DataFrame, private: DataFrame, id: str) -> DataFrame:
    return known.join(private.withColumn("_in", F.lit(True)), id, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def drop_invented(df: DataFrame) -> DataFrame:
    return df.filter("membership >= 1")


def flip_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows of membership other than 0; the label takes the membership's sign."""
    return df.filter("membership <> 0").withColumn(label, F.col(label) * F.signum("membership"))


def join_values(
    known: DataFrame, private: DataFrame, id: str, columns: list[str], *, eps_memb: float, eps_val: float, sens: float,
    seed: int, buckets: int | None = None, drop: bool = True, ledger: Ledger | None = None,
) -> DataFrame:
    """Known rows with their membership and an estimate of each private column; eps_val is split over the columns."""
    if ledger:
        ledger.charge(private, "join of values", eps_memb + eps_val)
    eps = eps_val / max(1, len(columns))
    if buckets is None:
        out = joined(known, private.select(id, *columns), id)
        out = out.withColumns(
            {"membership": sketch.own_membership(F.col(id), F.col("_in"), eps_memb, seed)}
            | {c: sketch.own_value(F.col(id), F.col(c), c, eps, sens, seed) for c in columns}
        ).drop("_in")
    else:
        out = sketch.decode(known, id, sketch.member_sketch(private, id, eps_memb, buckets, seed), "memb", buckets, seed, "membership")
        for c in columns:
            values = sketch.value_sketch(private, id, c, eps, sens, buckets, seed)
            out = sketch.decode(out, id, values, f"val.{c}", buckets, seed, c)
    return drop_invented(out) if drop else out


def join_signs(
    known: DataFrame, private: DataFrame, id: str, label: str, vector: str, total: int, k: int, *, eps_memb: float, eps_val: float,
    kind: str = "Ind", selection: str = "Same", p: list[float] | None = None, seed: int = 7, ledger: Ledger | None = None,
) -> DataFrame:
    """id, label, membership, vector: signs of the private rows under randomised response, random signs for the others.

    Same: the k likeliest columns by p. Unif, NonUnif: for each id k columns, others 0.
    """
    if ledger:
        ledger.charge(private, "join of signs", eps_memb + eps_val)
    out = joined(known.select(id, label), private.select(id, vector), id)
    return noisy_signs(out, id, label, vector, total, k, eps_memb=eps_memb, eps_val=eps_val, kind=kind, selection=selection, p=p, seed=seed)


def noisy_signs(
    out: DataFrame, id: str, label: str, vector: str, total: int, k: int, *, eps_memb: float, eps_val: float,
    kind: str = "Ind", selection: str = "Same", p: list[float] | None = None, seed: int | Column = 7, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``join_signs`` of rows that are ``joined`` already, with the columns to ``keep``; the seed may be one of them."""
    key = F.col(id)
    chosen = top_columns(p, k) if selection == "Same" and p else list(range(k))
    eps = response.split_selection(eps_val, selection)[1]
    flips = response.signs(key, kind, eps, total, k, seed, p, chosen if selection == "Same" else None)
    filler = F.array(*[sign(key, "fill", seed, i) for i in range(total)])
    out = out.withColumn("membership", sketch.own_membership(key, F.col("_in"), eps_memb, seed))
    cells = F.when(F.col("_in"), F.zip_with(F.col(vector), flips, lambda v, s: v * s)).otherwise(filler)
    if selection == "Same":
        cells = F.array(*[F.get(cells, F.lit(i)) for i in chosen])
    else:
        mask = row_mask(key, total, k, seed, p if selection == "NonUnif" else None)
        cells = F.zip_with(cells, mask, lambda v, m: v * m)
    return flip_labels(out.withColumn(vector, cells), label).select(*keep, id, label, "membership", vector)


def join_features(
    known: DataFrame, private: DataFrame, id: str, label: str, vector: str, dims: int, *, eps_memb: float, eps_val: float,
    data_type: str = "Real", sens: list[float] | None = None, seed: int = 7, bound: float = ROOT2, ledger: Ledger | None = None,
) -> DataFrame:
    """id, label, membership, vector: noisy dense features of the rows that the membership lets through.

    Real: cells plus sens_j * Laplace(dims / eps_val), rows without a partner from 0. Real Clip: then
    clipped to ``bound``. Binary: signs kept with probability 1 - exp(-eps_val / dims) / 2, rows
    without a partner are random signs times sqrt(2). Noise is drawn for surviving rows only.
    """
    if ledger:
        ledger.charge(private, "join of features", eps_memb + eps_val)
    out = joined(known.select(id, label), private.select(id, vector), id)
    return noisy_features(out, id, label, vector, dims, eps_memb=eps_memb, eps_val=eps_val, data_type=data_type, sens=sens, seed=seed, bound=bound)


def noisy_features(
    out: DataFrame, id: str, label: str, vector: str, dims: int, *, eps_memb: float, eps_val: float, data_type: str = "Real",
    sens: list[float] | Column | None = None, seed: int | Column = 7, bound: float = ROOT2, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``join_features`` of rows that are ``joined`` already, with the columns to ``keep``; seed and sensitivities may be of them."""
    key = F.col(id)
    out = flip_labels(out.withColumn("membership", sketch.own_membership(key, F.col("_in"), eps_memb, seed)), label)
    if data_type in ("Real", "Real Clip"):
        each = [F.get(sens, F.lit(i)) for i in range(dims)] if isinstance(sens, Column) else [F.lit(float(s)) for s in (sens or [ROOT2] * dims)]
        noise = [s * F.lit(dims / eps_val) for s in each]
        noisy = F.array(*[
            F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0)) + laplace(key, "feat", seed, noise[i], i) for i in range(dims)
        ])
        cells = clip(noisy, bound) if data_type == "Real Clip" else noisy
    elif data_type == "Binary":
        flips = response.independent_signs(key, [response.flip_probability(eps_val / dims)] * dims, seed, "feat")
        filler = F.array(*[sign(key, "fill", seed, i) * ROOT2 for i in range(dims)])
        cells = F.zip_with(F.when(F.col("_in"), F.col(vector).cast("array<double>")).otherwise(filler), flips, lambda v, s: v * s)
    else:
        raise ValueError(f"no data type {data_type}")
    return out.withColumn(vector, cells).select(*keep, id, label, "membership", vector)


def invention_rate(eps: float) -> float:
    """The probability e^-eps / (1 + e^-eps) that noise lets a row without a partner through."""
    return 0.0 if math.isinf(eps) else math.exp(-eps) / (1 + math.exp(-eps))
