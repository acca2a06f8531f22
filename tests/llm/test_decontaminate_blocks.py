"""Benchmarks in several blocks: the same result as in one, items longer than a block, ids of other types, edges."""

import random

from pyspark.sql import functions as F

from veiljoin.llm import decontaminate as d
from veiljoin.llm.common import folded_words


def windows(pieces, n=d.WINDOW):
    out = set()
    for item, text in pieces:
        w = folded_words(text)
        out |= {(item, tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def test_pieces_have_the_windows_of_their_item(spark):
    text = ", ".join(f"word{i}" for i in range(5000))
    for size in (60, 1000, 20_000):
        found = [*d.pieces(7, text, size, d.WINDOW)]
        assert windows(found) == windows([(7, text)]) and all(len(t) < size + 400 for _, t in found)
    million = " ".join(f"{i:x}" for i in range(1_100_000))
    found = [*d.blocks(spark.createDataFrame([(1, million)], "item_id long, text string"), "item_id", "text", d.BLOCK_CHARS)]
    assert len(found) >= 3 and all(len({w for _, t in b for w in folded_words(t)}) < 1_000_000 for b in found)
    assert sum(len(folded_words(t)) - d.WINDOW + 1 for b in found for _, t in b) == 1_100_000 - d.WINDOW + 1


def test_blocks_agree_with_one(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(f"mmlu-{i}", " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [" ".join([*draw.choices(words, k=20), *draw.choice(items)[1].upper().split(), *draw.choices(words, k=draw.randint(0, 300))]) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (100, None), (101, ""), (102, "w1 " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, hits int, key string")
    got = [sorted(map(str, d.decontaminate(docs, bench, block_chars=size).collect())) for size in (10**6, 300)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    out = {r.doc_id: r for r in d.decontaminate(docs, bench, block_chars=200).collect()}
    for i, text in enumerate(texts):
        have, hit, found = text.lower().split(), set(), set()
        for item, t in items:
            w = t.split()
            for k in range(max(1, len(w) - 12)):
                part = w[k : k + 13]
                for at in range(len(have) - len(part) + 1):
                    if have[at : at + len(part)] == part:
                        hit |= {*range(at, at + len(part))}
                        found.add(item)
        assert (out[i].n_hit, out[i]["items"]) == (len(hit), sorted(found))
    assert d.decontaminate(docs.limit(0), bench, block_chars=200).count() == 0
    assert d.decontaminate(docs.withColumn("more", F.lit(1)), bench, block_chars=200).columns[-5:] == ["n_words", "n_hit", "items", "contaminated", "spans"]
