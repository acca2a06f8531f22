"""Helpers that several operators share: the shared folder, word hashes and rolling hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many narrow rows (id plus a few bytes); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder; a cluster session gets an error, since no local folder would do.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_veiljoin_shared", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._veiljoin_shared = tempfile.mkdtemp(prefix="veiljoin-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole documents go to Python in batches of at most ``rows`` rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have few rows; else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes that are no word characters become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, unchanged; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash; the cache empties itself at 200,000 words, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all windows of a row of word hashes, by prefix sums.

    With an odd base b, sums S[i] of h[j] * b**-j give a window's hash as (S[i+n] - S[i]) * b**i.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.ones((2, max(4096, 2 * n)), np.uint64)
            steps[0, 1:], steps[1, 1:] = self.base, self.inverse
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.down[: len(h)], out=out[1:])
        return out

    def windows(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, np.uint64)
        sums = self.prefix(h)
        return (sums[n:] - sums[:-n]) * self.up[: len(h) - n + 1]
