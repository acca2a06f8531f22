"""The toxicity score against a brute-force scorer; the same lexicon from any order and partitioning; edges."""

import math
import random

from pyspark.sql import functions as F

from veiljoin.llm import toxicity as t
from veiljoin.llm.queries import held_out

SF = "/root/testdata/sf0.01"


def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels.filter(~held_out(F.col("doc_id")))


def brute(lexicon, text):
    """Every entry at every place of the folded text, without an automaton."""
    folded = t.fold(text)
    places = lambda word: [(i, i + len(word)) for i in range(len(folded)) if folded.startswith(word, i)]
    free = [x for phrase in lexicon.exceptions for x in places(t.fold(phrase))]
    weight = sum(w for e, w in lexicon.weights.items() for a, b in places(e) if not any(x <= a and b <= y for x, y in free))
    words = len(folded.split())
    a, b, c = lexicon.coefficients
    x = a + b * math.log1p(weight) + c * math.log1p(100 * weight / (words + 20))
    return 1 / (1 + math.exp(-x))


def test_scores_equal_brute_force(spark):
    docs, labels = tables(spark)
    lexicon = t.fit_lexicon(docs, labels)
    assert len(lexicon.weights) > 5
    texts = [r.text for r in docs.orderBy(F.desc(F.length("text"))).limit(4).collect() + docs.filter("doc_id % 9 = 0").collect() if len(r.text or "") < 60_000]
    rows = spark.createDataFrame([(x,) for x in [*texts, None, "", "a sore loser, you l0ser", "clown fish clown"]], "text string")
    for r in rows.select("text", t.toxicity_score(F.col("text"), lexicon).alias("s")).collect():
        assert math.isclose(r.s, brute(lexicon, r.text), rel_tol=1e-9)


def test_order_and_partitions_do_not_matter(spark):
    docs, labels = tables(spark)
    more = labels.limit(30).withColumn("toxic", 1 - F.col("toxic"))
    labels = labels.unionByName(more).unionByName(more)
    docs = docs.unionByName(docs.limit(50))
    first = t.fit_lexicon(docs, labels)
    again = t.fit_lexicon(docs.orderBy(F.desc("text")).repartition(13), labels.orderBy(F.desc("doc_id")).repartition(3))
    assert first.weights == again.weights and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(first.coefficients, again.coefficients))


def test_edges(spark):
    docs, labels = tables(spark)
    seeds = {f" {w} " for w in t.SEEDS}
    assert t.fit_lexicon(docs.limit(0), labels).weights.keys() == seeds == t.fit_lexicon(docs, labels.limit(0)).weights.keys()
    clashing = docs.withColumns({"y": F.lit("a"), "same": F.lit(1), "h": F.lit(2), "half": F.lit(3), "id": F.lit("b")})
    assert t.fit_lexicon(clashing, labels.withColumn("y", F.lit(5))).weights == t.fit_lexicon(docs, labels).weights
    rows = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "you idiot " * 40_000, 2.0)], "doc_id long, text string, score double")
    kept = t.reject_toxic(rows, t.Lexicon({" idiot ": 4.0}))
    assert kept.columns == rows.columns and kept.count() == 2


def test_phrases_of_long_texts():
    lexicon = t.Lexicon({" clown ": 2.0, " idiot ": 4.0, " cla": 1.0}, ("class clown", "clown fish", "a class clown idiot"))
    draw = random.Random(4)
    for _ in range(40):
        text = " ".join(draw.choices(["class", "clown", "idiot", "fish", "a", "tea"], k=draw.randint(0, 60)))
        assert math.isclose(lexicon.score(text), brute(lexicon, text), rel_tol=1e-9)
    total, words = lexicon.measure("class clown idiot " * 333_000)
    assert (total, words) == (4.0 * 333_000, 999_000)
