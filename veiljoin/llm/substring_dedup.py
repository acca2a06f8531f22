"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged into removal intervals.

A window's anchor is the smallest hash among its half-length subwindows. Equal windows have equal
anchors, and neighbouring windows mostly share one, so a run of windows with one anchor (a block, split where text repeats itself for long)
is the unit that is shuffled: about one row for thirteen words. Only where an anchor occurs in
several documents in different blocks are the blocks' windows themselves hashed and grouped.
Nothing is lost by this: a window whose anchor is in one document only occurs in that document only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, bound_batches, mix, plain_words, save, small

WINDOW = 50
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Windows of a block at most; only text that repeats within a window's length makes longer runs with one anchor.
BLOCK_WINDOWS = 1024
#: Stands for a null id, which comes after all others.
LAST = 2**63 - 1


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    k = 1
    while k < n:
        step = min(k, n - k)
        x = np.minimum(x[:-step], x[step:])
        k += step
    return x


def doc_blocks(h: np.ndarray, rolling: Rolling, window: int) -> tuple[np.ndarray, ...]:
    """anchor, content hash, first window and number of windows of each block."""
    half = max(1, window // 2)
    sums = rolling.prefix(h)
    parts = mix((sums[half:] - sums[:-half]) * rolling.up[: len(h) - half + 1])
    anchors = sliding_min(parts, window - half + 1)
    starts = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    at = np.arange(len(anchors))
    run = np.maximum.accumulate(np.where(starts, at, 0))
    first = np.flatnonzero((at - run) % BLOCK_WINDOWS == 0)
    past = np.append(first[1:], len(anchors))
    content = mix((sums[past - 1 + window] - sums[first]) * rolling.up[first] + (past - first).astype(np.uint64))
    return anchors[first], content, first, past - first


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null ids last), key (tells rows of one id apart) and text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).alias("text"),
    )


def list_blocks(rows: DataFrame, window: int) -> DataFrame:
    """id, key, blocks array of (anchor, content, first, n) of each row with at least one window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, rolling = WordHashes(), Rolling(BASE)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "key", "anchor", "content", "first", "n")}
            for i, key, text in zip(batch["id"], batch["key"], batch["text"]):
                words = plain_words(text)
                if len(words) < window:
                    continue
                a, c, f, n = doc_blocks(hashes.of(words), rolling, window)
                for name, value in zip(out, (i, key, a.view(np.int64), c.view(np.int64), f.astype(np.int32), n.astype(np.int32))):
                    out[name].append(value)
            yield pd.DataFrame(out, dtype=object)

    return rows.mapInPandas(run, "id bigint, key bigint, anchor array<bigint>, content array<bigint>, first array<int>, n array<int>")


def occurrences(listed: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("anchor", "content", "first", "n"))
    return listed.select("id", "key", zipped.alias("b")).select("id", "key", "b.anchor", "b.content", "b.first", "b.n")


def with_text(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows that have a list, with it; only their texts are shuffled if the ids are few."""
    picked = rows.join(small(lists.select("id", "key")), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return picked.join(lists, ["id", "key"])


def repeated_words(rows: DataFrame, window: int) -> DataFrame:
    """id, key, gone array of (first, n): runs of n windows whose sequence also starts in a smaller id."""
    listed = save(list_blocks(rows, window), "substring-blocks")
    anchors = save(
        occurrences(listed)
        .groupBy("anchor")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("content").alias("c0"), F.max("content").alias("c1"))
        .filter("low < high")
        .select("anchor", "low", (F.col("c0") != F.col("c1")).alias("mixed")),
        "substring-anchors",
    )
    found = save(
        occurrences(listed).join(anchors, "anchor").filter("mixed or id > low"), "substring-found"
    )
    # blocks that are alike wherever their anchor occurs: every window is in the smallest id too
    plain = found.filter("not mixed").select("id", "key", F.array(F.struct("first", "n")).alias("gone"))
    # the others: one example of each different block, in its smallest document, stands for all
    examples = (
        found.filter("mixed")
        .groupBy("anchor", "content")
        .agg(F.min(F.struct("id", "key", "first", "n")).alias("x"))
        .select("anchor", "content", "x.*")
    )
    lists = save(
        examples.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "content", "first", "n")).alias("blocks")), "substring-examples"
    )

    def window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, rolling = WordHashes(), Rolling(OTHER_BASE)
        for batch in batches:
            for i, text, blocks in zip(batch["id"], batch["text"], batch["blocks"]):
                all_windows = mix(rolling.windows(hashes.of(plain_words(text)), window)).view(np.int64)
                n = np.array([b["n"] for b in blocks])
                first = np.repeat([b["first"] for b in blocks], n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({
                    "id": i, "anchor": np.repeat([b["anchor"] for b in blocks], n), "content": np.repeat([b["content"] for b in blocks], n),
                    "at": at.astype(np.int32), "hash": all_windows[first + at],
                })

    hashed = save(
        with_text(rows, lists).select("id", "text", "blocks").mapInPandas(
            window_hashes, "id bigint, anchor bigint, content bigint, at int, hash bigint"
        ),
        "substring-windows",
    )
    # a window of one block only is in no smaller document than that block's smallest
    lowest = save(
        hashed.groupBy("anchor", "hash").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"),
        "substring-lowest",
    )
    known = (
        hashed.join(lowest, ["anchor", "hash"], "left")
        .groupBy("anchor", "content")
        .agg(F.collect_list(F.struct("at", F.coalesce("low", "id").alias("from"))).alias("windows"))
    )
    single = found.filter("mixed").join(known, ["anchor", "content"]).select(
        "id", "key",
        F.transform(
            F.filter("windows", lambda w: w["from"] < F.col("id")),
            lambda w: F.struct((F.col("first") + w["at"]).alias("first"), F.lit(1).alias("n")),
        ).alias("gone"),
    ).filter(F.size("gone") > 0)
    return save(
        plain.unionByName(single).groupBy("id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone")), "substring-gone"
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, removed array of (first, past), text.

    Words are runs of characters other than ASCII white space. A word goes if a window of
    ``window`` consecutive words that covers it also starts in a document with a smaller id,
    judged on the input. ``removed`` are the maximal word intervals that went, ``text`` is what
    stays, words joined by one space. Null texts have no words; documents shorter than a window
    stay whole; a null id counts as larger than any other. Rows that repeat an id don't count
    against each other. An empty table gives an empty result.

    Windows are equal if their anchor's and their own 64-bit hashes, of different bases, both are.
    """
    bound_batches(docs.sparkSession)
    rows = rows_of(docs, id_col, text_col)
    gone = repeated_words(rows, window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, removed, texts = [], [], []
            for text, lists in zip(batch["text"], batch["gone"]):
                words = plain_words(text)
                steps = np.zeros(len(words) + 1, np.int64)
                first = np.array([g["first"] for g in lists])
                np.add.at(steps, first, 1)
                np.add.at(steps, first + np.array([g["n"] for g in lists]) + window - 1, -1)
                out = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                sizes.append(len(words))
                removed.append([{"first": int(a), "past": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                texts.append(b" ".join(w for w, x in zip(words, out) if not x).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n_words": sizes, "removed": removed, "text": texts})

    span = "removed array<struct<first: int, past: int>>"
    changed = with_text(rows, gone).select("id", "key", "text", "gone").mapInPandas(cut, f"id bigint, key bigint, n_words bigint, {span}, text string")
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    ids = small(gone.select("id", "key"))
    whole = rows.join(ids, ["id", "key"], "left_anti").withColumn("text", plain).select(
        "id",
        F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n_words"),
        F.array().cast(span.removeprefix("removed ")).alias("removed"),
        "text",
    )
    copies = rows.join(ids, ["id", "key"], "left_semi").select("id", "key").groupBy("id", "key").agg(F.count(F.lit(1)).alias("times"))
    again = changed.join(copies, ["id", "key"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return whole.unionByName(again.select(*whole.columns)).select(
        F.when(F.col("id") < LAST, F.col("id")).alias(id_col), "n_words", "removed", "text"
    )
