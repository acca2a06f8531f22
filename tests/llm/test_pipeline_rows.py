"""Pipeline: what becomes of rows that share an id, repeat, or have none; the stages against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as p
from veiljoin.llm.toxicity import fit_lexicon
from veiljoin.llm.queries import held_out

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def run(stage, spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], DOCS).repartition(3)
    return sorted(((r.doc_id, r.text, r.lang) for r in stage(spark, df, SF).collect()), key=str)


def test_exact_stage_keeps_unique_texts(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "unique text", "x"), (3, "b", "x"), (3, "b", "x"), (3, "b ", "y"), (4, "c", "y"), (4, "c", "x"), (None, "a", "x"), (None, "n", "x"), (None, "n", "x"), (None, "only", None), (7, None, "x"), (8, "", "x")]
    assert run(p.exact, spark, rows) == sorted(
        [(1, "a", "x"), (2, "unique text", "x"), (3, "b", "x"), (3, "b ", "y"), (4, "c", "x"), (None, "n", "x"), (None, "only", None), (7, None, "x")], key=str
    )


def test_near_stage_keeps_unique_texts(spark):
    text = lambda k: " ".join([*(f"w{i}" for i in range(118)), f"x{k}", f"y{k}"])
    other = " ".join(f"u{i}" for i in range(90))
    rows = [(1, text(1), "x"), (5, other, "x"), (5, text(5), "x"), (7, text(7), "x"), (2, other, "x"), (9, "alone", "x"), (9, "another", "x"), (9, "another", "x"), (None, text(8), "x")]
    want = sorted([(1, text(1), "x"), (2, other, "x"), (9, "alone", "x"), (9, "another", "x"), (None, text(8), "x")], key=str)
    assert run(p.near, spark, rows) == want == run(p.near, spark, rows[::-1])


def test_stages_against_brute_force(spark):
    """Each stage's rows on the smallest documents, but for near-dedup, by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = lambda stage: {r.doc_id for r in stage(spark, docs, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out(F.col("doc_id")))
    lexicon = fit_lexicon(docs, labels)
    assert kept(p.toxicity) == {i for i, t in rows.items() if lexicon.score(t) < 0.3}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert kept(p.exact) == set(first.values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text or "")
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))
    clean = set()
    for i, t in rows.items():
        w, hit = words(t), set()
        for n, found in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    hit |= {*range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert kept(p.decontamination) == clean and clean != set(rows)
