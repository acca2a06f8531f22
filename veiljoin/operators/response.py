"""Randomised response on arrays of signs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.randomness import uniform

SELECTION_SHARE = 0.25


def split_selection(eps: float, selection: str) -> tuple[float, float]:
    """Budget for feature selection and for signs."""
    part = 0.0 if selection == "Unif" else SELECTION_SHARE * eps
    return part, eps - part


def flip_probability(eps: float, symmetric: bool = False) -> float:
    """exp(-eps) / 2, or with ``symmetric`` the textbook 1 / (1 + e^eps)."""
    return 1 / (1 + math.exp(eps)) if symmetric else math.exp(-eps) / 2


def independent_signs(id: Column, flips: list[float], seed: int, tag: str = "rr") -> Column:
    """-1 with each cell's own flip probability, else 1."""
    return F.array(*[F.when(uniform(id, tag, seed, i) < p, F.lit(-1.0)).otherwise(F.lit(1.0)) for i, p in enumerate(flips)])


def signs(id: Column, kind: str, eps: float, total: int, k: int, seed: int, p: list[float] | None = None, chosen: list[int] | None = None) -> Column:
    """An array of ``total`` signs of one row.

    Ind: eps / k for every cell. WeightedInd: eps in proportion to p over the chosen cells, 0 elsewhere.
    Dep: with probability (e^eps - 1) / (e^eps + 2^k - 1) the whole row stays, else all signs are uniform.
    """
    each = flips(kind, eps, total, k, p, chosen)
    if each is not None:
        return independent_signs(id, each, seed)
    stay = stay_probability(eps, k)
    return F.when(uniform(id, "rr.row", seed) < stay, F.array(*[F.lit(1.0)] * total)).otherwise(independent_signs(id, [0.5] * total, seed))


def flips(kind: str, eps: float, total: int, k: int, p: list[float] | None = None, chosen: list[int] | None = None) -> list[float] | None:
    """Each cell's own flip probability; None for Dep, where the row decides."""
    if kind == "Ind":
        return [flip_probability(eps / k)] * total
    if kind == "WeightedInd":
        if p is None or chosen is None:
            raise ValueError("WeightedInd needs p and the chosen columns, so it goes with selection Same only")
        whole = sum(p[i] for i in chosen)
        return [flip_probability(eps * p[i] / whole if i in chosen else 0.0) for i in range(total)]
    if kind == "Dep":
        return None
    raise ValueError(f"no sketch type {kind}")


def stay_probability(eps: float, k: int) -> float:
    """That a whole row of ``Dep`` stays."""
    return (math.exp(eps) - 1) / (math.exp(eps) + 2.0**k - 1)


def encode_signs(x: Column) -> Column:
    """Cells of -1 as 0, cells of 0 (columns that weren't chosen) as 0.5, cells of 1 as they are."""
    return F.transform(x, lambda v: (v + 1) / 2)
