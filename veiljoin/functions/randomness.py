"""Random draws as deterministic columns: each is a pure function of (seed, id, tag).

So they are the same in every partitioning, retry and plan, fold and push down like any other
expression, and SQL can repeat them. MD5 with a known seed is reproducible, **not private**: a
real release needs a secret ``seed``, for which ``secret_seed`` draws one.
"""

from __future__ import annotations

import hashlib
import math
import secrets

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str | int
TWO48 = float(2**48)


def secret_seed() -> int:
    return secrets.randbits(62)


def uniform(id: Column, tag: str, seed: int | Column, *parts: Part) -> Column:
    """Uniform in (0, 1), never at an end: 48 bits of md5(id|seed|tag|parts...). A column as seed, such as a trial's number, gives each row its own."""
    seeded = F.concat(seed.cast("string"), F.lit(f"|{tag}")) if isinstance(seed, Column) else F.lit(f"{seed}|{tag}")
    text = [id.cast("string"), seeded, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(TWO48)


def uniform_value(id: object, tag: str, seed: int, *parts: object) -> float:
    """The same number on the driver, for small coefficient tables."""
    text = "|".join(map(str, (id, seed, tag, *parts)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / TWO48


TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
ORDER = [i % 16 for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _md5_48(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first 48 bits of MD5 of ``n`` messages of one block; a word that all messages share is a number."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        word, turn = words[ORDER[i]], TURNS[i // 16][i % 4]
        f += a
        if isinstance(word, int):
            f += np.uint32((SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(SINES[i])
        turned = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return (a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> np.uint32(16))


class Ids:
    """Ids as text, by length, so that draws of many of them are array operations in a Python worker."""

    def __init__(self, ids: list[str], step: int = 16_384) -> None:
        held = [i.encode() for i in ids]
        sizes = np.array([len(i) for i in held], int)
        self.n, self.texts = len(held), held
        self.groups = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            for at in (own[i : i + step] for i in range(0, len(own), step)):
                self.groups.append((size, at, np.frombuffer(b"".join(held[i] for i in at), np.uint8).reshape(len(at), size)))

    def uniform(self, tag: str, seed: int, *parts: object) -> np.ndarray:
        """The numbers that ``uniform`` draws for the ids."""
        rest = "|".join(["", str(seed), tag, *map(str, parts)]).encode()
        out = np.empty(self.n)
        for size, at, digits in self.groups:
            length = size + len(rest)
            if length > 55:  # more than a block
                out[at] = [int(hashlib.md5(self.texts[i] + rest).hexdigest()[:12], 16) for i in at]
                continue
            tail = rest + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
            mixed = -(-size // 4)  # words with letters of the id
            block = np.empty((len(at), 4 * mixed), np.uint8)
            block[:, :size] = digits
            block[:, size:] = np.frombuffer(tail[: 4 * mixed - size], np.uint8)
            words = list(np.ascontiguousarray(block.view("<u4").T)) + np.frombuffer(tail[4 * mixed - size :], "<u4").tolist()
            out[at] = _md5_48(words, len(at))
        return (out + 0.5) / TWO48


def sign(id: Column, tag: str, seed: int, *parts: Part) -> Column:
    """A sign hash: -1 or 1."""
    return F.when(uniform(id, f"{tag}.sign", seed, *parts) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def bucket(id: Column, tag: str, seed: int, buckets: int) -> Column:
    """A bucket hash: uniform over 0 .. buckets - 1."""
    return F.floor(uniform(id, f"{tag}.bucket", seed) * buckets).cast("bigint")


def geometric(id: Column, tag: str, seed: int, eps: float, *parts: Part) -> Column:
    """Two-sided geometric noise with p = exp(-eps); 0 if eps is infinite."""
    if math.isinf(eps):
        return F.lit(0).cast("bigint")
    draw = lambda k: F.floor(F.ln(uniform(id, f"{tag}.geometric{k}", seed, *parts)) / F.lit(-float(eps)))
    return (draw(1) - draw(2)).cast("bigint")


def laplace(id: Column, tag: str, seed: int, scale: Column | float, *parts: Part) -> Column:
    """Laplace noise by its inverse distribution function."""
    u = uniform(id, f"{tag}.laplace", seed, *parts) - 0.5
    return -(scale if isinstance(scale, Column) else F.lit(float(scale))) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def gaussian(id: Column, tag: str, seed: int, *parts: Part) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = (uniform(id, f"{tag}.gauss{k}", seed, *parts) for k in (1, 2))
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def gaussian_value(id: object, tag: str, seed: int, *parts: object) -> float:
    u, v = (uniform_value(id, f"{tag}.gauss{k}", seed, *parts) for k in (1, 2))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
