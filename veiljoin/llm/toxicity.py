"""Toxicity: a weighted lexicon, learnt from labelled rows, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, bound_batches, folded_words, mix, save

#: Bounds of the labelled sample that the model is fitted on: rows with label 1, rows with label 0.
SAMPLE_ROWS = (4000, 6000)
#: Lengths of word beginnings that may enter the lexicon as stems; whole words enter too.
STEMS = range(3, 13)
#: An entry needs this many labelled-1 rows and this z score of its share there against elsewhere.
MIN_ROWS, MIN_Z = 3, 4.0
#: Words that count from the start, as much as a learnt word of this weight, and phrases in which they don't.
SEEDS = ("idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "worthless")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser", "stupid question")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһӏкмтвнгαεοριυτκνχаёϲⅼ",
        "aeopcyxijsdhlkmtbhraeopiutkvxaecl",
    )
)
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
TABLE = str.maketrans(HOMOGLYPHS | DIGITS | WIDE)
GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits as letters, words between single spaces, a space at both ends."""
    return f" {GAPS.sub(' ', (text or '').lower().translate(TABLE)).strip()} "


@dataclass
class Lexicon:
    """Entries are `` stem`` (a word's beginning) or `` word `` and have weights; score = logistic of the hits."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-4.0, 1.5, 0.5)
    _scan: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scan": None}

    @property
    def scan(self) -> ahocorasick.Automaton:
        if self._scan is None:
            self._scan = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._scan.add_word(word := fold(phrase), (len(word), None))
            for entry, weight in self.weights.items():
                self._scan.add_word(entry, (len(entry), weight))
            self._scan.make_automaton()
        return self._scan

    def measure(self, text: str | None) -> tuple[float, int]:
        """The weight of all hits outside exception phrases, and the number of words."""
        folded = fold(text)
        hits = [(end - n + 1, end, weight) for end, (n, weight) in self.scan.iter(folded)]
        free = sorted((a, b) for a, b, weight in hits if weight is None)
        # of the phrases that start no later than a hit, the one that reaches furthest decides
        starts, reach = [a for a, _ in free], [-1, *accumulate((b for _, b in free), max)]
        total = sum(w for a, b, w in hits if w is not None and reach[bisect_right(starts, a)] < b)
        return total, folded.count(" ") - 1 if len(folded) > 2 else 0

    def score(self, text: str | None) -> float:
        return float(logistic(features(*self.measure(text)) @ np.array(self.coefficients)))


def features(weight: float, words: int) -> np.ndarray:
    """Hits, and hits normalised by length."""
    return np.array([1.0, math.log1p(weight), math.log1p(100 * weight / (words + 20))])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Newton's method; the ridge spares the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def count_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that hold each word or stem, by label and half of the sample."""
    counts: dict[tuple[int, int], Counter] = {(y, half): Counter() for y in (0, 1) for half in (0, 1)}

    def flush() -> pd.DataFrame:
        out = [(e, y, half, n) for (y, half), c in counts.items() for e, n in c.items()]
        for c in counts.values():
            c.clear()
        return pd.DataFrame(out, columns=["entry", "y", "half", "n"])

    for batch in batches:
        for text, y, half in zip(batch["text"], batch["y"], batch["half"]):
            words = set(fold(text).split())
            entries = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if k < len(w)}
            counts[int(y), int(half)].update(entries)
            if sum(map(len, counts.values())) > 300_000:
                yield flush()
    yield flush()


def fingerprint(text: Column) -> Column:
    """The least hash of a text's five-word shingles: copies share it, near copies mostly."""

    @F.pandas_udf("bigint")
    def least(texts: pd.Series) -> pd.Series:
        hashes, rolling = WordHashes(), Rolling(0xA0761D6478BD642F)
        found = [hashes.of(folded_words(text) or [b""]) for text in texts]
        return pd.Series([int(mix(rolling.windows(h, min(5, len(h)))).min().view(np.int64)) for h in found], dtype="int64")

    return least(text)


def passes(pos: Column, neg: Column, p1: int, p0: int) -> Column:
    """Whether an entry may pass the tests of ``choose``, of p1 and p0 rows of the two labels; it has a hair's breadth to spare."""
    if not p1 or not p0:
        return F.lit(False)
    share = (pos + neg) / (p1 + p0)
    z = (pos / p1 - neg / p0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / p1 + 1 / p0))
    return (pos >= MIN_ROWS) & (z >= MIN_Z - 1e-9)


def choose(table: pd.DataFrame, pos: np.ndarray, neg: np.ndarray, rows: tuple[float, float]) -> dict[str, float]:
    """The lexicon from counts: best first, without entries that begin alike."""
    p1, p0 = rows
    if not p1 or not p0:
        return {f" {w} ": SEED_WEIGHT for w in SEEDS}
    share = (pos + neg) / (p1 + p0)
    z = (pos / p1 - neg / p0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / p1 + 1 / p0))
    weight = np.log((pos + 0.5) / (p1 + 1)) - np.log((neg + 0.5) / (p0 + 1))
    good = np.flatnonzero((pos >= MIN_ROWS) & (z >= MIN_Z) & (weight > 1))
    entries = table["entry"].to_numpy()
    # the log-likelihood ratio prefers a stem that only label 1 has to a shorter, commoner one
    rate, seen = p1 / (p1 + p0), np.maximum(pos + neg, 1)
    gain = pos * np.log(np.maximum(pos / seen, 1e-12) / rate) + neg * np.log(np.maximum(neg / seen, 1e-12) / (1 - rate))
    order = sorted(good, key=lambda i: (-round(gain[i], 9), -len(entries[i]), entries[i]))
    chosen: dict[str, float] = {}
    heads: set[str] = set()
    for i in order:
        e = entries[i]
        starts = {e[:k] for k in range(4, len(e) + 1)}
        if e in heads or starts & chosen.keys():
            continue
        chosen[e] = float(weight[i])
        heads |= starts
    return {f" {w} ": SEED_WEIGHT for w in SEEDS if not any(f" {w} ".startswith(e) for e in chosen)} | chosen


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: tuple[int, int] = SAMPLE_ROWS,
) -> Lexicon:
    """Learn entries, weights and the score's coefficients from labelled rows.

    The sample holds at most ``sample_rows`` rows of either label, those with the smallest hash of
    their id, less copies and near copies of each other, so that one text in many copies does not
    make its words entries; Spark counts entries over it by half. A lexicon from either half scores the other,
    so that the coefficients are fitted to hits on unseen rows; the final lexicon is that of both.
    The intercept is moved from the sample's share of label 1 to that of all labelled rows. Rows
    without a label, id or text are left out; without rows of both labels the seed words remain.
    An id that is labelled twice counts once, as 1 if it ever is; of near copies the least text stays; rows
    that repeat an id all count. So the lexicon depends on the rows alone, not on their order or partitions.
    """
    bound_batches(docs.sparkSession)
    labelled = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = labelled.agg(F.max(F.col(label_col).cast("int")).alias("y")).withColumn("h", F.xxhash64("id"))
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    part = [known.filter(F.col("y") == y).orderBy("h", "id").limit(n) for y, n in ((1, sample_rows[0]), (0, sample_rows[1]))]
    picked = part[0].unionByName(part[1])
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
        .join(F.broadcast(picked), "id")
        .select("text", "y", fingerprint(F.col("text")).alias("same"))
        .groupBy("y", "same")
        .agg(F.min("text").alias("text"))
        .select("text", "y", F.pmod(F.xxhash64(F.lit("half"), "same"), F.lit(2)).cast("int").alias("half"))
    )
    sample = save(sample, "toxicity-sample")
    rows = {(r.y, r.half): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    n = lambda y, *halves: sum(rows.get((y, h), 0) for h in halves)
    counted = sample.mapInPandas(count_entries, "entry string, y int, half int, n bigint")
    cell = lambda y, h: F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"c{y}{h}")
    cells = counted.groupBy("entry").agg(*[cell(y, h) for y in (0, 1) for h in (0, 1)])
    whole_test = passes(F.col("c10") + F.col("c11"), F.col("c00") + F.col("c01"), n(1, 0, 1), n(0, 0, 1))
    half_tests = [passes(F.col(f"c1{h}"), F.col(f"c0{h}"), n(1, h), n(0, h)) for h in (0, 1)]
    table = cells.filter(whole_test | half_tests[0] | half_tests[1]).toPandas().sort_values("entry", ignore_index=True)
    c = {k: table[k].to_numpy(float) for k in ("c00", "c01", "c10", "c11")}
    halves = [Lexicon(choose(table, c[f"c1{h}"], c[f"c0{h}"], (n(1, h), n(0, h)))) for h in (0, 1)]
    whole = Lexicon(choose(table, c["c10"] + c["c11"], c["c00"] + c["c01"], (n(1, 0, 1), n(0, 0, 1))))
    if not n(1, 0, 1) or not n(0, 0, 1):
        return whole

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [halves[1 - int(h)].measure(t) for t, h in zip(batch["text"], batch["half"])]
            yield pd.DataFrame({"y": batch["y"], "w": [x[0] for x in found], "n": [x[1] for x in found]})

    seen = sample.mapInPandas(measured, "y int, w double, n bigint").toPandas()
    x = np.array([features(*v) for v in zip(seen["w"], seen["n"])])
    w = fit_logistic(x, seen["y"].to_numpy(float))
    w[0] += math.log(totals[1] / totals[0]) - math.log(n(1, 0, 1) / n(0, 0, 1))
    whole.coefficients = tuple(map(float, w))
    return whole


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """A score from 0 to 1 of each whole text. Null and empty texts have the score of no hits."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.score)

    return score(F.coalesce(text, F.lit("")))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score under the threshold, with their columns unchanged."""
    mine = "toxicity_score_"
    return docs.withColumn(mine, toxicity_score(F.col(text_col), lexicon)).filter(F.col(mine) < threshold).drop(mine)
