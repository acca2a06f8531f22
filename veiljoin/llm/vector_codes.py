"""Vector codes: product quantisation with integer codebooks, exact at every size.

Components become integers floor(scale * x). A vector is cut into equal consecutive parts; each part position
has a codebook. Rounds assign every part to the nearest entry and move entries to the floored mean of
their parts. All arithmetic is in integers, so results don't depend on batches, partitions or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, save, small

#: Rows whose distances to all entries are held at once: rows x entries numbers of 64 bits.
ROWS = 4096


class Codebooks(NamedTuple):
    """``entries`` has the codebook of each part: entries x components, 64-bit integers. Its size is parts x entries x components."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position within the part, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null, and without components that are null, infinite or no numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def integer_vectors(rows: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """Columns vec_id, label, v (integers) of the usable rows, written to the shared folder; and the length of vectors.

    ValueError if lengths differ or aren't a multiple of ``parts``, or if a component is so large that sums of
    squares of a part would leave 64 bits.
    """
    kept = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    seen = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.max(top)).first()
    length, most = seen[0] or 0, (seen[2] or 0.0) * scale + 1
    if seen[0] != seen[1] or length % parts:
        raise ValueError(f"vectors have {seen[0]} to {seen[1]} components; they must have one length, a multiple of {parts}")
    if 4 * most * most * max(1, length // parts) >= 2**62:
        raise ValueError(f"components up to {seen[2]} are too large for sums of squares in 64 bits")
    kind = "int" if most < 2**31 else "bigint"
    return save(kept.select("vec_id", "label", ints.cast(f"array<{kind}>").alias("v")), "vector-integers"), length


def matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, length)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries: |x|^2 - 2 x.c + |c|^2 in 64-bit integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def nearest(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its components, the index of the nearest entry (the lowest of several) and the squared distance."""
    width = books.shape[2]
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        d = distances(part, book)
        best = d.argmin(1)
        yield part, best, d[np.arange(len(d)), best]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def moved(vectors: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """One round: every task adds up its parts by entry, a shuffle merges the sums; entries without parts stay."""
    spread = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = spread.value
        total, count = np.zeros(at.shape, np.int64), np.zeros(at.shape[:2], np.int64)
        for batch in blocks(batches):
            for p, (part, best, _) in enumerate(nearest(matrix(batch, length), at)):
                order = best.argsort(kind="stable")
                used, first = np.unique(best[order], return_index=True)
                total[p, used] += np.add.reduceat(part[order], first, axis=0)
                count[p] += np.bincount(best, minlength=at.shape[1])
        p, e = count.nonzero()
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = vectors.select("v").mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
    # Decimals, as sums over all rows may leave 64 bits; one row an entry comes to the driver.
    merged = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.entries.shape[2]))
    )
    new = books.entries.copy()
    for part, entry, n, *total in merged.collect():
        new[part, entry] = [int(s) // n for s in total]
    spread.unpersist()
    return Codebooks(new, books.scale)


def fit_codebooks(vectors: DataFrame, length: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Start from the vectors with the smallest ids, those without an id last, then move the entries ``rounds`` times."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    whole = np.array([r.v for r in start], np.int64).reshape(len(start), parts, length // parts)
    books = Codebooks(np.ascontiguousarray(whole.transpose(1, 0, 2)), scale)
    for _ in range(rounds if len(start) else 0):
        books = moved(vectors, books, length)
    return books


def assign_codes(vectors: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """Columns vec_id, label, code (two hex digits a part up to 256 entries), error (squared distances over all parts)."""
    digits = max(2, -(-max(books.entries.shape[1] - 1, 0).bit_length() // 4))
    spread = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [format(i, f"0{digits}x") for i in range(spread.value.shape[1])]
        for batch in blocks(batches):
            error, code = np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for _, best, d in nearest(matrix(batch, length), spread.value):
                error += d
                code = [c + names[b] for c, b in zip(code, best.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def vector_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable rows of (vec_id, embedding, label), with label_error, and the codebooks.

    Rows whose vector is null or holds null, infinite or undefined components are dropped. Rows that repeat, or
    share an id, all get their code; entries start as the smallest rows by (vec_id, vector), null ids last; with
    fewer rows than entries there are fewer entries. Nearest entries that tie: the lowest index. Vectors of no
    components have distance 0 to everything. An empty table gives no rows. Only the three columns matter, so others
    may clash. ``label_error`` is ``error`` added up over rows of equal label, null labels together: partial sums
    first, then a join that broadcasts one row a label, up to ``small``'s bound.
    """
    bound_batches(rows.sparkSession, 10_000)
    vectors, length = integer_vectors(rows, parts, scale)
    books = fit_codebooks(vectors, length, parts, entries, rounds, scale)
    coded = save(assign_codes(vectors, books, length), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(small(totals), F.col("label").eqNullSafe(F.col("same"))).drop("same"), books
