"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, scanned over all documents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, folded_words, save, small

WINDOW = 13
#: Benchmark characters in one automaton, so at most half as many words, each of which may be a letter of its own.
#: About 250 MB in a worker. A larger benchmark is scanned in several passes, each with the next block.
BLOCK_CHARS = 2_000_000
#: Words of the original text, before A-Z become a-z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OWN = ("n_words", "hits", "items", "n_hit", "contaminated", "spans")


def symbol(i: int) -> str:
    """The i-th character of the automaton's alphabet, past the surrogates; character 1 stands for all other words."""
    return chr(i + 2 if i + 2 < 0xD800 else i + 2 + 0x800)


class Matcher:
    """Words of the block are letters of an alphabet, so the automaton reads one letter a word."""

    def __init__(self, items: list[tuple[object, str]], window: int) -> None:
        self.letters: dict[bytes, str] = {}
        windows: dict[str, set] = {}
        for item, text in items:
            word = "".join(self.letters.setdefault(w, symbol(len(self.letters))) for w in folded_words(text))
            for i in range(max(1, len(word) - window + 1)) if word else ():
                windows.setdefault(word[i : i + window], set()).add(item)
        self.scan = ahocorasick.Automaton()
        for word, found in windows.items():
            self.scan.add_word(word, (len(word), found))
        if windows:
            self.scan.make_automaton()
        self.any = bool(windows)

    def __call__(self, words: list[bytes]) -> tuple[list[int], list]:
        """Maximal runs of hit words as [first, past the last, ...], and the items found, sorted."""
        if not self.any:
            return [], []
        runs: list[list[int]] = []
        items: set = set()
        get = self.letters.get
        for end, (n, found) in self.scan.iter("".join([get(w, "\1") for w in words])):
            items |= found
            first = end + 1 - n
            while runs and runs[-1][0] >= first:
                runs.pop()
            if runs and runs[-1][1] >= first:
                runs[-1][1] = end + 1
            else:
                runs.append([first, end + 1])
        return [x for r in runs for x in r], sorted(items)


#: The automaton of the block that this worker process last scanned with, so that its next tasks need not build it.
_built: dict[str, Matcher] = {}


def matcher(name: str, block: object, window: int) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(block.value, window)
    return _built[name]


def pieces(item: object, text: str, size: int, window: int) -> Iterator[tuple[object, str]]:
    """The item, or if it is longer than ``size`` pieces of it that have the same windows together."""
    if len(text) <= size:
        yield item, text
        return
    held, start = [], 0
    for m in WORD.finditer(text):
        if held and held[-1][1] - start > size and len(held) >= 2 * window:
            yield item, text[start : held[-1][1]]
            held = held[len(held) - window + 1 :]
            start = held[0][0] if held else m.start()
        held.append(m.span())
    yield item, text[start:]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, window: int = WINDOW) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items, streamed, in blocks of at most about ``size`` characters."""
    block: list[tuple[object, str]] = []
    held = 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).dropna().toLocalIterator():
        for item, text in pieces(row.i, row.t, size, window):
            if block and held + len(text) > size:
                yield block
                block, held = [], 0
            block.append((item, text))
            held += len(text)
    if block:
        yield block


def spans(text: str | None, hits: list[int]) -> list[int]:
    """Hit words as character offsets of the original text: [start, end, start, end, ...]."""
    if text is None or not len(hits):
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [x for a, b in zip(hits[::2], hits[1::2]) for x in (at[a][0], at[b - 1][1])]


def merged(runs: list[tuple[int, int]]) -> list[int]:
    """Maximal runs, flat, of runs that may overlap."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [x for r in out for x in r]


def block_hits(keyed: DataFrame, block: list[tuple[object, str]], window: int, kind: str) -> DataFrame:
    """key, hits, items of the texts that hold a window of the block, once each: no text is carried along."""
    held, name = keyed.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = matcher(name, held, window)
        for batch in batches:
            found = [(key, *match(folded_words(text))) for key, text in zip(batch["key"], batch["text"])]
            yield pd.DataFrame([x for x in found if x[1]], columns=["key", "hits", "items"], dtype=object)

    found = keyed.mapInPandas(scan, f"key binary, hits array<int>, items array<{kind}>")
    return save(found.groupBy("key").agg(F.min(F.struct("hits", "items")).alias("x")).select("key", "x.*"), "decontaminate-hits")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents with n_words, n_hit, items, contaminated and spans appended.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, an
    item without words none. ``n_hit`` counts the words inside any occurrence, ``items`` lists the
    items found, ``spans`` has character offsets in the original text. A document is contaminated
    if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words. Items with a null id
    or text are left out; equal items are all listed; ids may have any type that sorts. Rows that repeat
    get the same verdict. Columns of these five names are replaced.

    One block of the benchmark is a single pass over the documents. With more, each block's pass gives only the
    hits of the texts that have any, by a 128-bit hash of the text, and a last pass joins these.
    """
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in OWN]
    spark: SparkSession = docs.sparkSession
    kind = dict(benchmark.select(F.col(item_col)).dtypes)[item_col]
    ahead = blocks(benchmark, item_col, item_text_col, block_chars, window)
    block, after = next(ahead, []), next(ahead, None)
    none = {"hits": F.array().cast("array<int>"), "items": F.array().cast(f"array<{kind}>")}
    if after is None:
        rows, held, name = docs.select(*rest, *[c.alias(k) for k, c in none.items()]), spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def found(batch: pd.DataFrame, words: list[list[bytes]]) -> list[tuple[list[int], list]]:
            return [*map(matcher(name, held, window), words)]
    else:
        keyed = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
        parts = block_hits(keyed, block, window, kind)
        while after is not None:  # the driver holds this block and the next
            block, after = after, next(ahead, None)
            parts = parts.unionByName(block_hits(keyed, block, window, kind))
        hits = parts.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        mine = docs.select(*rest).withColumn("decontaminate_key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
        hits = small(save(hits.withColumnRenamed("key", "decontaminate_key"), "decontaminate-all"))
        rows = mine.join(hits, "decontaminate_key", "left").select(*rest, *[F.coalesce(k, c).alias(k) for k, c in none.items()])

        def found(batch: pd.DataFrame, words: list[list[bytes]]) -> list[tuple[list[int], list]]:
            return [(merged([*zip(h[::2].tolist(), h[1::2].tolist())]), sorted(x)) for h, x in zip(batch["hits"], batch["items"])]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [folded_words(text) for text in batch[text_col]]
            told = found(batch, words)
            yield batch.assign(
                n_words=[len(w) for w in words], hits=[h for h, _ in told], items=[i for _, i in told],
                spans=[spans(text, h) for text, (h, _) in zip(batch[text_col], told)],
            )

    schema = rows.withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast("array<int>")}).schema
    out = rows.mapInPandas(finish, schema)
    ends_less_starts = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint"))
    n_hit = F.aggregate(ends_less_starts, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return (
        out.withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select(*rest, "n_words", "n_hit", "items", "contaminated", "spans")
    )
