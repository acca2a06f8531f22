"""SQL of the queries, built from the same draws that functions.randomness makes."""

from __future__ import annotations

import math

SEED = 7
TWO48 = "281474976710656e0"


def u(id: str, tag: str, *parts: object, seed: int | str = SEED) -> str:
    """Uniform in (0, 1); ``seed`` is a number or, as text, a column."""
    seeded = f"({seed})::VARCHAR || '|{tag}'" if isinstance(seed, str) else f"'{seed}|{tag}'"
    text = " || '|' || ".join([f"({id})::VARCHAR", seeded, *[f"({p})::VARCHAR" for p in parts]])
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT + 0.5e0) / {TWO48})"


def sign(id: str, tag: str, *parts: object, seed: int | str = SEED) -> str:
    return f"(CASE WHEN {u(id, tag + '.sign', *parts, seed=seed)} < 0.5e0 THEN -1e0 ELSE 1e0 END)"


def bucket(id: str, tag: str, buckets: int) -> str:
    return f"floor({u(id, tag + '.bucket')} * {buckets})::BIGINT"


def geometric(id: str, tag: str, eps: float, *parts: object, seed: int | str = SEED) -> str:
    draw = lambda k: f"floor(ln({u(id, f'{tag}.geometric{k}', *parts, seed=seed)}) / {-float(eps)!r}e0)::BIGINT"
    return f"({draw(1)} - {draw(2)})"


def laplace(id: str, tag: str, scale: float, *parts: object, seed: int | str = SEED) -> str:
    v = f"({u(id, tag + '.laplace', *parts, seed=seed)} - 0.5e0)"
    return f"(-({float(scale)!r}e0) * sign({v}) * ln(1e0 - 2e0 * abs({v})))"


def gaussian(id: str, tag: str, *parts: object) -> str:
    a, b = (u(id, f"{tag}.gauss{k}", *parts) for k in (1, 2))
    return f"(sqrt(-2e0 * ln({a})) * cos({2 * math.pi!r}e0 * {b}))"


def own_membership(id: str, present: str, eps: float, seed: int | str = SEED) -> str:
    return f"((CASE WHEN {present} THEN 1e0 ELSE 0e0 END) + {sign(id, 'memb', seed=seed)} * {geometric(id, 'memb', eps, seed=seed)})"
