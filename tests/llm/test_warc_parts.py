"""WARC archives read in many parts, long payloads, repeated rows and ids, and chains that break."""

import base64
import hashlib
import random

from veiljoin.llm import warc

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_many_parts_of_one_file(spark, tmp_path):
    draw = random.Random(3)
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(i, f"http://a/{i}", "".join(draw.choice(["é", "word ", magic, "\r\n\r\n", "WARC/1.1\r\n"]) for _ in range(draw.randint(0, 40)))) for i in range(120)]
    path = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (3000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            out = warc.read_warc(spark, path).collect()
            assert sorted(r.page_id for r in out) == list(range(120)) and all(r.intact for r in out)
            assert {r.page_id: r.digest for r in out} == {i: digest(t) for i, _, t in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_reachable_against_a_walk(spark):
    draw = random.Random(5)
    rows = []
    for f in range(3):
        ats = sorted({0, *draw.sample(range(1, 2000), 150)})
        rows += [(f"f{f}", at // 400 * 400, at, draw.choice([None, *[x for x in ats if x > at][:3], at + 1])) for at in ats]
    after = {(f, at): then for f, _, at, then in rows}
    want = set()
    for f in ("f0", "f1", "f2"):
        at = 0
        while (f, at) in after:
            want.add((f, at))
            at = after[f, at]
    nodes = spark.createDataFrame(rows, "file string, block long, at long, next long")
    assert {(r.file, r.at) for r in warc.reachable(nodes).collect()} == want
    chain = spark.createDataFrame([("f", at // 90 * 90, at, at + 10) for at in range(0, 5000, 10)], nodes.schema)
    assert warc.reachable(chain).count() == 500


def test_edges(spark, tmp_path):
    long = "x" * 3_000_000 + "WARC/1.1\r\n" + "é" * 100_000
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, None), (3, "u", ""), (None, "u", "n"), (None, "u", "n"), (5, "u\r\nX: 1", "n")]
    df = spark.createDataFrame([(*r, "a", 7) for r in rows], f"{PAGES}, record_type string, first_id long")
    out = warc.read_warc(spark, warc.write_warc(df, str(tmp_path / "w"))).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.digest) for r in out), key=str)
    want = [
        (1, "response", None, digest(long)), (2, "revisit", 1, digest(long)), (2, "revisit", 1, digest(long)), (3, "response", None, digest("")), (3, "response", None, digest("")),
        (None, "revisit", 5, digest("n")), (None, "revisit", 5, digest("n")), (5, "response", None, digest("n")),
    ]
    assert got == sorted(want, key=str) and all(r.intact for r in out)
    small = {r.page_id: r.record_type for r in warc.read_warc(spark, warc.write_warc(df.filter("page_id = 2"), str(tmp_path / "s"), min_bytes=10**8)).collect()}
    assert small == {2: "response"}
