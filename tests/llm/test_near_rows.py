"""Near-dedup: ids that repeat, hot shingles, long lists of pairs, against an independent brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veiljoin.llm import near_dedup as n

DOCS = "doc_id long, text string"


def classes(df, **more):
    return sorted(((r.doc_id, r.class_id, r.kept) for r in n.near_classes(df, **more).collect()), key=str)


def jaccard_classes(rows, threshold):
    """Classes by the plain Jaccard similarity of bags of five words, by comparing all pairs."""
    from collections import Counter

    bags = {}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in bags}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in bags:
        for b in bags:
            if b < a and sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in bags}


def test_texts_that_share_an_id(spark):
    words = [f"w{i}" for i in range(120)]
    text = lambda k: " ".join([*words[:118], f"x{k}", f"y{k}"])
    other = " ".join(f"u{i}" for i in range(90))
    rows = [(1, text(1)), (5, other), (5, text(5)), (7, text(7)), (2, other), (9, "alone"), (9, "another"), (9, "another")]
    want = sorted([(1, 1, True), (5, 2, False), (5, 1, False), (7, 1, False), (2, 2, True), (9, 9, True), (9, 9, True), (9, 9, True)], key=str)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "a", 1) for i, t in order], f"{DOCS}, rep string, class_id int")
        assert classes(df.coalesce(1)) == want and classes(df.repartition(5)) == want


def test_against_plain_jaccard(spark):
    draw = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for k in range(60):
        base = draw.choices(vocabulary, k=draw.randint(3, 150))
        for _ in range(draw.randint(1, 4)):
            copy = [draw.choice(vocabulary) if draw.random() < draw.choice([0, 0.01, 0.05]) else w for w in base]
            rows.append((len(rows), " ".join(copy).upper() if draw.random() < 0.3 else ", ".join(copy)))
    # weights from 0.75 to 1 move plain similarities: 0.8 to between 0.75 and 0.85 at the most
    strict, loose = jaccard_classes(rows, 0.8 / (0.8 + 0.2 * 0.75) + 1e-9), jaccard_classes(rows, 0.6 / (0.6 + 0.2) - 1e-9)
    got = {r.doc_id: r.class_id for r in n.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(set(got.values())) < len(got) and len(set(strict.values())) < len(got)
    assert all(got[i] == got[strict[i]] for i in got) and all(loose[i] == loose[got[i]] for i in got)


@pytest.fixture(scope="module")
def flat():
    import numpy as np

    return np.ones(n.DF_BUCKETS, np.float32)


def open_tokens(spark, texts, weights):
    members = texts.select("id", F.col("id").alias("root"), F.lit(True).alias("probe"))
    return n.save(n.prefixes(members, texts, weights, 0.8), "test-tokens")


def test_a_shingle_that_20000_texts_share(spark, flat):
    shared = "one rare run of words"
    texts = spark.range(20_000).select("id", F.concat(F.lit(shared + " "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat_ws("_", "id", i)), " ")).alias("text"))
    texts = n.save(texts.unionByName(spark.createDataFrame([(20_000, f"{shared} " + " ".join(f"7_{i}" for i in range(1, 12)))], "id long, text string")), "test-texts")
    tokens = open_tokens(spark, texts, flat)
    assert tokens.groupBy("token").count().agg(F.max("count")).first()[0] > 4000
    pairs = n.candidate_pairs(tokens, texts, flat, 0.8)
    found = [(r.a, r.b) for r in pairs.collect()]
    assert (20_000, 7) in found and len(found) < 100


def test_split_shingles_lose_no_pair(spark, flat, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(k, " ".join(draw.choices(words[: draw.choice([1, 2, 12])], k=draw.randint(1, 60)))) for k in range(80)]
    for k in range(80, 160):
        base = rows[draw.randrange(80)][1].split()
        base[draw.randrange(len(base))] = "x"
        rows.append((k, " ".join(base)))
    texts = spark.createDataFrame(rows, "id long, text string")
    shingles, bags = n.Shingles(), {}
    for k, t in rows:
        h, c, _ = shingles(t)
        bags[k] = dict(zip(h.tolist(), c.tolist()))
    want = set()
    for a in bags:
        for b in range(a):
            low = sum(min(c, bags[b].get(h, 0)) for h, c in bags[a].items())
            if low >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - low):
                want.add((a, b))
    tokens = open_tokens(spark, texts, flat)
    for limit in (10**9, 0):
        monkeypatch.setattr(n, "HOT_PAIRS", limit)
        assert want <= {(r.a, r.b) for r in n.candidate_pairs(tokens, texts, flat, 0.8).collect()}


def test_one_document_in_many_pairs(spark, flat, monkeypatch):
    monkeypatch.setattr(n, "PART_PAIRS", 3)
    texts = spark.createDataFrame([(i, "a b c d e f g h i " * 4 + f"x{i}") for i in range(20)], "id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 20)] + [(2, 1)], "a long, b long")
    out = n.verify(pairs, texts, flat).collect()
    assert len(out) == 20 and all(0.9 < r.similarity < 1 for r in out)
