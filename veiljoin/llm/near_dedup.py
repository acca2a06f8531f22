"""Near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, bound_batches, folded_words, mix, save, small

SHINGLE, THRESHOLD = 5, 0.8
#: Bands and samples a band: two texts of similarity 0.8 meet with probability 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, ROWS = 14, 4
#: Shingles are counted in this many buckets for their document frequency, whatever the size of the corpus.
DF_BUCKETS = 1 << 16
#: Share of a weight that follows the IDF; the rest counts any shingle alike, so that what a large
#: group of near copies shares doesn't lose to what sets them apart.
IDF_SHARE = 0.25
BASE = 0xC2B2AE3D27D4EB4F
#: A shingle that may give more pairs than this, about a second's work of a task, is split by the next shingle that a
#: pair shares, for which its texts are read again; fewer pairs cost less than that.
HOT_PAIRS = 1_000_000
#: Pairs with one document that go to one task.
PART_PAIRS = 2000


class Shingles:
    """A text's shingles as sorted 64-bit hashes with counts."""

    def __init__(self) -> None:
        self.hashes, self.rolling = WordHashes(), Rolling(BASE)

    def hashed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the shingles, in text order.

        A text of fewer words than a shingle is one shingle. A text without words is one shingle
        of its own characters, so only equal ones are similar.
        """
        words = folded_words(text) or [b"\0" + (text or "").encode("utf-8", "surrogatepass")]
        h = self.hashes.of(words)
        n = min(SHINGLE, len(words))
        return h, mix(self.rolling.windows(h, n) + np.uint64(n))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Hashes, counts, and a hash of the whole word sequence."""
        h, found = self.hashed(text)
        whole = mix(self.rolling.windows(h, len(h)) + np.uint64(len(h)))[0]
        values, counts = np.unique(found, return_counts=True)
        return values, counts, int(whole.view(np.int64))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle of each bucket, and documents, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, total, rows = Shingles(), np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total[np.unique((shingles.hashed(text)[1] >> np.uint64(48)).astype(np.uint16))] += 1
            rows += len(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": [*at, DF_BUCKETS], "n": [*total[at], rows]})

    sums = texts.select("text").mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DF_BUCKETS + 1, np.int64)
    out[sums["bucket"]] = sums["n"]
    return out[:-1], int(out[-1])


def idf_weights(df: np.ndarray, rows: int) -> np.ndarray:
    """Weights from 1 - IDF_SHARE to 1. The buckets' mean is what unrelated shingles add; it is taken off."""
    own = np.maximum(df - df.mean(), 1.0)
    return (1 - IDF_SHARE + IDF_SHARE * np.log1p(rows / own) / np.log1p(max(rows, 1))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: per hash function, Gamma(2, 1) variates r and c and a uniform b.

    The variates of a shingle come from a table that its hash selects; the sample is the shingle and
    its step t = floor(ln w / r + b), with the least ln c - r (t + 1 - b), ties by hash.
    """

    def __init__(self, functions: int, size: int = 1 << 14, seed: int = 7) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        r, c = draw.gamma(2.0, size=(2, size, functions))
        self.table = np.stack([r, draw.random((size, functions)), np.log(c)], axis=1).astype(np.float32)
        self.mask = np.uint64(size - 1)

    def __call__(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        best = picked = None
        for k in range(0, len(h), 1024):
            part = h[k : k + 1024]
            drawn = self.table.take((part & self.mask).astype(np.int64), axis=0)
            r, b, a = drawn[:, 0], drawn[:, 1], drawn[:, 2]
            t = np.log(w[k : k + 1024])[:, None] / r
            t += b
            np.floor(t, out=t)
            np.subtract(t, b, out=b)
            b += 1
            b *= r
            a -= b
            low = a.argmin(axis=0)
            cols = np.arange(a.shape[1])
            value, sample = a[low, cols], mix(part[low] + t[low, cols].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if best is None:
                best, picked = value, sample
            else:
                less = value < best
                best, picked = np.where(less, value, best), np.where(less, sample, picked)
        return picked


def signatures(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """id, doc, key, whole (hash of the word sequence), odd (mean weight of its shingles), bands array: one row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sampler, band = Shingles(), Sampler(BANDS * ROWS), Rolling(BASE)
        for batch in batches:
            wholes, odd, bands = [], [], []
            for text in batch["text"]:
                h, n, whole = shingles(text)
                w = weights[bucket(h)]
                odd.append(float(w.mean()))
                picked = sampler(h, n * w).reshape(BANDS, ROWS)
                key = np.zeros(BANDS, np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(BASE) + picked[:, j])
                wholes.append(whole)
                bands.append(mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            yield batch[["id", "doc", "key"]].assign(whole=wholes, odd=odd, bands=bands)

    return texts.mapInPandas(run, "id bigint, doc bigint, key bigint, whole bigint, odd double, bands array<bigint>")


def ordered(h: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles from rare to common, an order that all texts share, with what each weighs and what it and its followers weigh."""
    w = weights[bucket(h)]
    order = np.lexsort((h, -w))
    own = (n * w.astype(np.float64))[order]
    return h[order], own, np.cumsum(own[::-1])[::-1]


def prefixes(members: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The members with a row for each shingle of their prefix, its weight and what it and its followers weigh.

    A text's prefix ends where what follows weighs less than ``threshold`` of the whole. The first shingle that two
    similar texts share is in the prefix of the heavier one, and as ``light``, where what follows weighs
    2 threshold / (1 + threshold) of the whole, in that of the lighter one.
    """
    low, high = threshold * (1 - 1e-9), 2 * threshold / (1 + threshold) * (1 - 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in batches:
            found = []
            for text in batch["text"]:
                h, _, after = ordered(*shingles(text)[:2], weights)
                keep = after >= low * after[0]
                found.append((h[keep].view(np.int64), after[keep], after[keep] >= high * after[0], after[0]))
            yield batch[["id"]].assign(tokens=[x[0] for x in found], rests=[x[1] for x in found], lights=[x[2] for x in found], weight=[x[3] for x in found])

    picked = texts.select("id", "text").join(small(members.select("id")), "id", "left_semi").dropDuplicates(["id"])
    found = picked.mapInPandas(run, "id bigint, tokens array<bigint>, rests array<double>, lights array<boolean>, weight double")
    zipped = F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("rests").alias("rest"), F.col("lights").alias("light"))).alias("t")
    return members.join(found.select("id", "weight", zipped), "id").select(*members.columns, "weight", "t.*")


def split_tokens(tokens: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The rows of hot shingles, once for each shingle that may be the next that a pair shares.

    Where a shingle is the first that two similar texts share, the next one is followed, it included, by what they must
    share less the first one's weight; where that is nothing, the first may be all that they share.
    """
    low, high = threshold * (1 - 1e-9), 2 * threshold / (1 + threshold) * (1 - 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "first", "token", "light")}
            for i, text, hot in zip(batch["id"], batch["text"], batch["hot"]):
                h, own, after = ordered(*shingles(text)[:2], weights)
                hot = set(np.asarray(hot, np.int64).view(np.uint64).tolist())
                for k in [k for k, x in enumerate(h.tolist()) if x in hot]:
                    heavy, light = low * after[0] - own[k], high * after[0] - own[k]
                    past = k + 1 + int((after[k + 1 :] >= heavy).sum())
                    keys, lights = mix(h[k + 1 : past] ^ mix(h[k : k + 1])), after[k + 1 : past] >= light
                    if heavy <= 0:
                        keys, lights = np.append(keys, mix(h[k : k + 1])), np.append(lights, light <= 0)
                    out["id"] += [i] * len(keys)
                    out["first"] += [int(h[k].view(np.int64))] * len(keys)
                    out["token"] += keys.view(np.int64).tolist()
                    out["light"] += lights.tolist()
            yield pd.DataFrame(out)

    hot = tokens.groupBy("id").agg(F.collect_set("token").alias("hot"))
    picked = texts.select("id", "text").join(small(hot.select("id")), "id", "left_semi").dropDuplicates(["id"]).join(hot, "id")
    found = picked.mapInPandas(run, "id bigint, first bigint, token bigint, light boolean").withColumnRenamed("light", "also")
    rows = tokens.withColumnRenamed("token", "first").join(found, ["id", "first"])
    return rows.withColumn("light", F.col("light") & F.col("also")).select(*tokens.columns)


def verify(pairs: DataFrame, texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """a, b, similarity of each pair: the weighted Jaccard similarity of whole texts."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in batches:
            found = [shingles(text)[:2] for text in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "h": [h.tobytes() for h, _ in found], "n": [n.astype(np.int32).tobytes() if (n > 1).any() else None for _, n in found],
            })

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for batch in batches:
            out = []
            for b, h1, n1, h2, n2 in zip(batch["b"], batch["h1"], batch["n1"], batch["h2"], batch["n2"]):
                if left is None or b != last:
                    last, left = b, unpack(h2, n2)
                out.append(similarity(*unpack(h1, n1), *left))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    def unpack(h: bytes, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(h, np.uint64)
        w = weights[bucket(h)]
        return h, w if n is None else w * np.frombuffer(n, np.int32)

    def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
        _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
        both = float(np.minimum(w1[i], w2[j]).sum(dtype=np.float64))
        return both / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - both)

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    packed = save(
        texts.select("id", "text").join(small(save(ids, "near-ids")), "id", "left_semi").dropDuplicates(["id"]).mapInPandas(pack, "id bigint, h binary, n binary"), "near-packed"
    )
    first = packed.select(F.col("id").alias("a"), F.col("h").alias("h1"), F.col("n").alias("n1"))
    second = packed.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    # a document that is in very many pairs goes to several tasks
    parts = save(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).cast("int").alias("parts")).filter("parts > 1"), "near-parts")
    if not parts.isEmpty():
        count = F.coalesce("parts", F.lit(1))
        pairs = pairs.join(small(parts), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), count).cast("int").alias("part"))
        second = second.join(small(parts), "b", "left").select("b", "h2", "n2", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
        return pairs.join(first, "a").join(second, ["b", "part"]).mapInPandas(compare, "a bigint, b bigint, similarity double")
    return pairs.join(first, "a").join(second, "b").mapInPandas(compare, "a bigint, b bigint, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id, root: each node of the edges (a, b) with the smallest node of its component.

    Large and small stars in turn: every node links its larger neighbours, then all its smaller
    ones, to the least node it knows, until nothing changes.
    """
    edges = save(edges.select("a", "b").filter("a <> b").distinct(), "near-edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(
            lowest.select("a", F.col("m").alias("b"))
        )
        edges = save(star.distinct(), "near-edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def candidate_pairs(tokens: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """a, b with a > b: members of several components, one of them to be probed, that may be similar by the rows of ``prefixes``."""
    uses = tokens.groupBy("token").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("probe").alias("probe"),
        (F.count(F.when(F.col("light"), 1)) * F.count(F.lit(1))).alias("pairs"),
    ).filter("r0 <> r1 and probe and pairs > 0")
    uses = save(uses.select("token", (F.col("pairs") > HOT_PAIRS).alias("hot")), "near-uses")
    held = tokens.join(uses.filter("not hot").select("token"), "token", "left_semi")
    if not uses.filter("hot").isEmpty():
        hot = save(tokens.join(uses.filter("hot").select("token"), "token", "left_semi"), "near-hot")
        held = held.unionByName(split_tokens(hot, texts, weights, threshold))
    held = save(held, "near-held")
    side = lambda df, x: df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "probe", "rest", "weight")], F.col("id").alias(x))
    enough = F.lit(threshold / (1 + threshold) * (1 - 1e-9)) * (F.col("weight_a") + F.col("weight_b"))
    return (
        side(held.filter("light"), "a").join(side(held, "b"), "token")
        .filter((F.col("weight_a") <= F.col("weight_b")) & (F.least("rest_a", "rest_b") >= enough))
        .filter((F.col("root_a") != F.col("root_b")) & (F.col("probe_a") | F.col("probe_b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def near_pairs(sketched: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """Pairs of representatives that span all classes.

    All documents of a band's bucket are compared with one of them, the one whose shingles are most
    common: as many pairs as members. Buckets whose members then still are in several components
    get a second round: members outside their bucket's largest component are compared with members
    of other components with which they share a shingle of both prefixes, from which on both weigh
    as much as similar texts must share; no others can be similar. Shingles whose members are all of one component
    give no pairs, and those with very many members are split by the next shingle that a pair shares.
    """
    key = F.posexplode("bands").alias("band", "value")
    members = save(sketched.select("id", "odd", key), "near-bands")
    hub = F.min(F.struct(F.round("odd", 4).alias("odd"), "id"))
    shared = members.groupBy("band", "value").agg(hub["id"].alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "value", "b")
    placed = save(members.select("band", "value", "id").join(save(shared, "near-shared"), ["band", "value"]), "near-buckets")
    stars = verify(save(placed.filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), "near-pairs"), texts, weights)
    linked = save(stars.filter(F.col("similarity") >= threshold).select("a", "b"), "near-stars")
    roots = components(linked)
    told = save(
        placed.join(roots, "id", "left").select("band", "value", "id", F.coalesce("root", "id").alias("root")), "near-told"
    )
    parts = told.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band", "value").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ids = (
        told.join(save(mixed.select("band", "value", "most"), "near-mixed"), ["band", "value"])
        .groupBy("id", "root").agg(F.max(F.col("root") != F.col("most")).alias("probe"))
    )
    tokens = save(prefixes(save(open_ids, "near-open"), texts, weights, threshold), "near-tokens")
    more = save(candidate_pairs(tokens, texts, weights, threshold), "near-more")
    if more.isEmpty():
        return linked
    return linked.union(verify(more, texts, weights).filter(F.col("similarity") >= threshold).select("a", "b"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id, kept, text_key, class_key.

    A class is a connected component of links of similarity ``threshold`` or more, its id the
    smallest id in it, whose row is kept. Texts of equal words are one representative and are not
    compared with each other. Shingles are five words, lower-cased; weights are counts times a
    damped IDF over all rows. Null texts count as empty; texts without words are similar only to
    equal ones. Rows that repeat an id and a text carry the same verdict; rows that share an id but
    not a text are judged apart, told from each other by ``text_key``, a 64-bit hash of the text; their
    classes, which may have one id in common, are told apart by ``class_key``. A null id is a class of
    its own, kept, with null keys of its class. An empty table gives an empty result. Ids are integers.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = rows.filter("doc is not null").withColumn("id", F.col("doc"))
    # nodes are ids, but a 62-bit hash of id and text, negative, for ids that have several texts
    several = save(texts.groupBy("doc").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).filter("k0 <> k1").select("doc", F.lit(True).alias("several")), "near-several")
    apart = not several.isEmpty()
    if apart:
        node = -F.xxhash64("doc", "key").bitwiseAND(2**62 - 1) - 1
        texts = texts.join(small(several), "doc", "left").withColumn("id", F.when(F.col("several"), node).otherwise(F.col("doc"))).drop("several")
    weights = idf_weights(*document_frequencies(texts))
    sketched = save(signatures(texts.select("id", "doc", "key", "text"), weights), "near-sketches")
    # a band's key beside the hash of the words makes 128 bits, so texts that differ don't count as copies
    sketched = sketched.withColumn("also", F.get("bands", F.lit(0)))
    copies = save(sketched.groupBy("whole", "also").agg(F.min("id").alias("rep")), "near-copies")
    single = save(sketched.join(copies, ["whole", "also"]).select("id", "doc", "key", "rep", "odd", "bands"), "near-members")
    roots = components(near_pairs(single.filter("id = rep").dropDuplicates(["id"]).select("id", "odd", "bands"), texts, weights, threshold))
    found = (
        single.select("doc", "key", "rep")
        .join(roots.withColumnsRenamed({"id": "rep"}), "rep", "left")
        .select("doc", "key", F.coalesce("root", "rep").alias("class_key"))
        .withColumn("class_id", F.col("class_key"))
    )
    if apart:
        found = save(found, "near-found")
        least = found.groupBy("class_key").agg(F.min("doc").alias("least"))
        found = found.join(least, "class_key").select("doc", "key", "class_key", F.col("least").alias("class_id"))
    none = F.lit(None).cast("bigint")
    return found.unionByName(rows.filter("doc is null").select("doc", "key", none.alias("class_key"), none.alias("class_id"))).select(
        F.col("doc").alias(id_col), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"), F.col("key").alias("text_key"), "class_key"
    )
