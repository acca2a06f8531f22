"""URL rules against plain loops; Poisson tables against sums of terms; edges of both."""

import math
import random

from pyspark.sql import functions as F

from veiljoin.llm import mixing, url_filter


def test_rules_against_loops(spark):
    draw = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "acom", "c.b.a.com"]
    rules = list({(draw.choice(hosts), "/" + "".join(draw.choices("ab/", k=draw.randint(0, 4))), draw.choice(["allow", "block"])) for _ in range(60)})
    rules += rules[:5]
    urls = [f"{draw.choice(['http', 'x'])}://{draw.choice(hosts)}/{''.join(draw.choices('ab/', k=draw.randint(0, 6)))}{draw.choice(['', '?a/b', '#x'])}" for _ in range(300)]
    urls += [urls[0]] * 50 + ["http://A.com/" + "ab/" * 30_000, None, "", "http://", "a.com/ab"]
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, rules, ranges=7).collect()}
    assert len(out) == len(urls)
    for k, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max((x[:4] for x in fits), default=None)
        assert out[k].rule == (best and best[2] + best[3]) and (out[k].host, out[k].path) == (host, path)
        assert out[k].verdict == (min(x[4] for x in fits if x[:4] == best) if best else "allow")


def test_poisson_tables(spark):
    rates = {"a": 0.0, "b": 0.3, "c": 7.0, "d": 1500.0, "e": 24.0}
    found = mixing.poisson_table(spark.createDataFrame([*rates.items()], "source string, rate double")).collect()
    assert {r.source for r in found} == set(rates)
    for r in found:
        rate, past, total = rates[r.source], r.least + len(r.cdf), 0.0
        for k in range(past):
            total += math.exp(-rate + (k * math.log(rate) if rate else 0) - math.lgamma(k + 1)) if rate or not k else 0
            assert abs(total - (r.cdf[k - r.least] if k >= r.least else 0)) < 1e-9
        assert abs(r.cdf[-1] - 1) < 1e-9


def test_tables_of_large_rates_are_short(spark):
    rate = 1e8
    (r,) = mixing.poisson_table(spark.createDataFrame([("a", rate)], "source string, rate double")).collect()
    assert len(r.cdf) < 25 * math.sqrt(rate) and r.least > rate - 13 * math.sqrt(rate) and abs(r.cdf[-1] - 1) < 1e-9
    # quantiles by the normal law with its skewness correction, whose error is of the order of 1 / rate
    for z in (-3.0, -1.0, 0.0, 2.0):
        want = (1 + math.erf(z / math.sqrt(2))) / 2
        k = rate + z * math.sqrt(rate) + (z * z - 1) / 6 - 0.5
        assert abs(r.cdf[round(k) - r.least] - want) < 1e-4


def test_a_row_of_very_many_copies(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("big").alias("source"), F.lit(7).alias("n"), F.lit(8).alias("row"))
    out = mixing.mix_sources(docs, shuffle=False)
    assert out.columns == [*docs.columns, "copy", "mix_key"] and out.filter("n <> 7 or row <> 8").isEmpty()
    rare = out.filter("source = 'rare'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect()
    assert len(rare) == 2 and all(r.c == r.d == r.m and abs(r.c - 15_000) < 6 * math.sqrt(15_000) for r in rare)
    assert out.filter("source = 'rare'").select(F.spark_partition_id()).distinct().count() > 1


def test_mixing_edges(spark):
    rows = [(k, "t", "big") for k in range(300)] + [(k, None, None) for k in range(300, 330)] + [(1, "t", "big"), (None, "x" * 100_000, "one"), (None, "", "one")]
    docs = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, text string, source string, copy int, mix_key double")
    out = mixing.mix_sources(docs, epochs=3.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    found = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(found[s] - len(rows)) < 6 * math.sqrt(len(rows)) for s in ("big", None)) and set(found) == {"big", None, "one"}
    same = [r["count"] for r in out.filter("doc_id = 1").groupBy("copy").count().collect()]
    assert all(n == 2 for n in same)
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys)
    weighted = mixing.mix_sources(docs, {"big": 1.0, "": 1.0}).groupBy("source").count().collect()
    assert {r.source for r in weighted} == {"big", None} and mixing.mix_sources(docs.limit(0)).count() == 0
    again = mixing.mix_sources(docs.repartition(7).withColumn("text", F.upper("text"))).drop("text")
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix_sources(docs).drop("text").collect()))
