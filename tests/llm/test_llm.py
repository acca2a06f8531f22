"""Operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veiljoin.llm import chat, common, decontaminate, exact_dedup, html_extract, mixing, near_dedup, substring_dedup, toxicity, url_filter, warc
from veiljoin.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"w{i % 7001}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def edge_rows(spark):
    same = " ".join(f"a{i}" for i in range(80))
    return docs(spark, [(1, None, "s"), (2, "", None), (3, same, "s"), (4, same.replace(" ", "  "), "s"), (4, same.replace(" ", "  "), "s"), (None, same, "t"), (6, LONG, "s"), (7, "x " + same, "s")])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "documents pages benchmark labels conversations embeddings".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(SQL[name])
    order = [d[0] for d in want.description]
    norm = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got = sorted(map(norm, (tuple(r[c] for c in order) for r in QUERIES[name](spark, SF).collect())), key=str)
    assert got == sorted(map(norm, want.fetchall()), key=str)


def test_exact_dedup_edges_and_collisions(spark):
    for hashed in (exact_dedup.md5_binary, lambda c: F.lit(b"0"), lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 1))):
        out = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(edge_rows(spark), content_hash=hashed).collect()]
        assert sorted(out, key=str) == sorted(
            [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 4, True), (4, 3, 4, False), (4, 3, 4, False), (None, 3, 4, False), (6, 6, 1, True), (7, 7, 1, True)], key=str
        )
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_substring_dedup_edges(spark):
    out = {(r.doc_id, r.n_words): r for r in substring_dedup.remove_repeats(edge_rows(spark)).collect()}
    assert out[(3, 80)].removed == [] and out[(4, 80)].text == "" and out[(None, 80)].text == ""
    assert out[(7, 81)].text == "x" and out[(6, 60_000)].n_words == 60_000 and out[(1, 0)].text == ""
    assert substring_dedup.remove_repeats(edge_rows(spark)).count() == 8 and substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_near_dedup_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    sh = near_dedup.Shingles()
    weights = near_dedup.idf_weights(*near_dedup.document_frequencies(table))
    sets = {r.doc_id: dict(zip(*(x.tolist() for x in sh(r.text)[:2]))) for r in rows}
    w = lambda h: float(weights[h >> 48])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if both := sets[a].keys() & sets[b].keys():
                low = sum(min(sets[a][h], sets[b][h]) * w(h) for h in both)
                high = sum(n * w(h) for s in (sets[a], sets[b]) for h, n in s.items()) - low
                if low / high >= 0.8:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()} == {i: find(i) for i in ids}


def test_near_dedup_edges(spark):
    out = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_classes(edge_rows(spark)).collect()), key=str)
    assert out == sorted([(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (4, 3, False), (None, None, True), (6, 6, True), (7, 3, False)], key=str)
    assert near_dedup.near_classes(docs(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {r.id: r.root for r in near_dedup.components(edges).collect()} == {i: 0 for i in range(1, 41)} | {100: 90}


def test_decontamination_spans_blocks_and_edges(spark):
    bench = spark.createDataFrame([(1, "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "tiny"), (3, None), (4, "!!")], "item_id long, text string")
    rows = docs(spark, [(1, "Say: TWO three, four five six seven eight nine ten eleven twelve thirteen fourteen. End", "s"), (2, None, "s"), (3, "A Tiny one", "s"), (4, "clean", "s")])
    for size in (10**6, 10):
        out = {r.doc_id: r for r in decontaminate.decontaminate(rows.withColumn("hits", F.lit(1)), bench, block_chars=size).collect()}
        a = out[1]
        assert (a.n_words, a.n_hit, a["items"], a.contaminated) == (15, 13, [1], True)
        assert a.text[a.spans[0] : a.spans[1]].startswith("TWO three") and a.text[a.spans[0] : a.spans[1]].endswith("fourteen")
        assert (out[3].n_hit, out[3]["items"]) == (1, [2]) and not out[4].contaminated and out[2].n_words == 0
    assert decontaminate.decontaminate(rows, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b<\\s>", "[[INST]", "", None, "\n<</SYS>>\n", "[ROLE]x[/ROLE]", " \\", "<</s>", "[/INST", "INST] <s"]
    rows = [(k, 0, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool[/ROLE]", None) for t in texts)]
    df = spark.createDataFrame([*rows, (900, 0, "user", "q"), (900, 1, "assistant", "a</s>"), (901, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("*", chat.read_chats(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("t"))
    got = {r.conv_id: r for r in out.collect()}
    for k, _, role, text in rows:
        assert [(t.role, t.text) for t in got[k].turns] == [(role or "", text or "")], (role, text)
        assert all(w not in "".join(s.text for s in got[k].segments[1:2]) for w in chat.TEMPLATE["control"])
    assert got[900].valid and got[900].t == "a</s>" and not got[901].valid
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", "é" * 10), (2, "u", fake), (3, None, None), (4, "a\r\nb", "x" + fake + fake), (5, "u", fake), (6, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    out = {r.page_id: r for r in warc.read_warc(spark, warc.write_warc(df, str(tmp_path / "w"))).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6] and all(r.intact for r in out.values())
    for i, _, h in pages:
        data = (h or "").encode()
        assert out[i].digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and out[i].payload_length == len(data)
    assert (out[5].record_type, out[5].refers_to, out[6].refers_to, out[3].record_type) == ("revisit", 2, 3, "response")
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_html_text(spark):
    page = '<html><body><nav>menu</nav><div class="share">Share me</div><article><h1>T{0}</h1><p>Body&nbsp;{0} <b>bold</b>er<p>x &lt; y</p><section class="comments">no</section><script>"</p>"</script></article><footer>f</footer>'
    loose = "<div class=x>Same words</div><div class=y>Own words {0}</div>"
    rows = [(i, "http://a.com/1", page.format(i)) for i in range(3)] + [(10 + i, "http://b.com/", loose.format(i)) for i in range(4)] + [(20, None, None), (21, "u", "<p>only")]
    out = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "T1 Body 1 bolder x < y" and out[11] == "Own words 1" and out[20] == "" and out[21] == "only"


def html_texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_keeps_text_that_differs_from_its_template_node(spark, tag):
    page = lambda *blocks: f"<body><{tag}>" + "".join(f"<{t}>{x}</{t}>" for t, x in blocks) + f"</{tag}>"
    long = lambda i: [("h1", f"Title {i}"), ("p", f"First {i}"), ("h2", f"Head {i}"), ("p", f"Second {i}")]
    rows = [(1, "http://a.com/", page(*long(1))), (2, "http://a.com/", page(("p", "Only words")))]
    rows += [(i, "http://a.com/", page(("p", "Same notice"), *long(i))) for i in (3, 4, 5)]
    out = html_texts(spark, rows)
    assert out[2] == "Only words" and out[1] == "Title 1 First 1 Head 1 Second 1"


def test_html_finds_templates_of_any_size_in_any_order(spark):
    wide = "<body>" + "".join(f"<div class={'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}>cell {{0}} {i}</div>" for i in range(390))
    rows = [(i, "http://a.com/", wide.format(i)) for i in range(3)]
    rows += [(i, "http://a.com/", f"<body><div class=x>Same words</div><div class=y>Own words {i}</div>" + "".join(f"<h4 class={c}>{c}{i}</h4>" for c in "abcdefghij")) for i in range(3, 8)]
    want = html_texts(spark, rows)
    assert want[5] == "Own words 5 a5 b5 c5 d5 e5 f5 g5 h5 i5 j5" and want[1].count("cell 1") == 390 and html_texts(spark, rows[::-1]) == want
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for limit in (8_000_000, -1):
        assert {r.page_id: r.text for r in html_extract.extract_text(pages, broadcast_bytes=limit).collect()} == want


def test_html_keeps_what_copies_or_articles_share(spark):
    rows = []
    for host, tag in (("a.com", "article"), ("b.com", "div class=x")):
        page = lambda i, more="": f"<head><script>{len(rows)}</script></head><body><{tag}><h1>Title {i}</h1><p>Text {i}</p>{more}</{tag.split()[0]}>"  # noqa: B023, E731
        for i in (0, 0, 0, 1, 2):
            rows.append((len(rows), f"http://{host}/", page(i, "<h2>Head</h2><ul>Own words</ul>" if i == 0 else "")))
    for i in range(4):
        rows.append((20 + i, "http://c.com/", f"<body><h5>Menu words</h5><article><h1>Title {i}</h1><h2>References</h2><p>Text {i}</p></article>"))
    out = html_texts(spark, rows)
    assert out[0] == out[2] == out[5] == out[7] == "Title 0 Text 0 Head Own words" and out[8] == "Title 1 Text 1"
    assert out[21] == "Title 1 References Text 1"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><p>Own words</p></div>', '<main class="with-sidebar"><p>Own words</p></main>', '<article class="post comments-open">Own words</article>',
        '<div id="page" class="nav-fixed"><article>Own words</article></div>', '<div class="no-banner">Own words</div>', '<div class="notice"><article>Own words</article></div>x',
        '<article class="notice">Own words</article>', '<div class="social"><p>Own words<div class="share">Us</div></div><div class="nav-menu">Menu</div>',
        '<article><p>Own words</article><div class="comments"><article class="comment">No</article></div><div class="cookie-notice">x</div>',
    ],
)
def test_html_drops_by_whole_tokens(page):
    assert html_extract.main_text(f"<body><nav>Menu</nav>{page}") == "Own words"


@pytest.mark.parametrize("raw", ["<svg class=x />", "<math/>", "<select>", "<noscript>", "<svg>", "<template>", "<svg width=1/><svg>x</svg>", "<iframe src=x>", "<math><mi>x</mi></math>"])
def test_html_goes_on_after_raw_elements(raw):
    assert html_extract.main_text(f"<article><p>Own {raw} words</p></article><div>x</div>") == "Own words"
    assert html_extract.main_text("<article>Own words<script>no") == "Own words"
    assert html_extract.main_text("<article><svg>Own <svg><svg>x</svg>y</svg><select> words <select><option>x</select>") == "Own words"


def test_html_on_articles(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, SF).collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)


def test_url_filter_edges(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://WWW.Example.com/en/x?q"), (4, "http://a.example.com/en/"), (5, "x://net/fr/"), (6, "http://com"), (7, "http://a.net/es/#"), (7, "http://a.net/es/#")]
    out = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect() if r.rule) 
    assert out == [(3, "www.example.com/en/", "allow"), (4, "example.com/en/", "block"), (5, "net/fr/", "block"), (7, "net/es/", "block"), (7, "net/es/", "block")]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_toxicity_held_out_and_folding(spark):
    lexicon = toxicity.Lexicon({" idiot ": 4.0})
    assert lexicon.measure("You 1d10t")[0] == 4 and lexicon.measure("іdіоt")[0] == 4 and lexicon.measure("idiotic")[0] == 0
    assert toxicity.Lexicon({" clown ": 4.0}).measure("a clown fish, a clown")[0] == 4
    assert 0 <= lexicon.score(None) <= 1 and lexicon.score("") == lexicon.score(None)
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.5 and (clean.predicted == 1).mean() <= 0.05
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_lexicon(edge_rows(spark), none).score("a moron") > 0


def test_mixing_rates(spark):
    rows = docs(spark, [(i, "t", "a" if i % 10 else "b") for i in range(4000)])
    out = {r.source: r["count"] for r in mixing.mix_sources(rows, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(out["a"] - 2000) < 200 and abs(out["b"] - 2000) < 200
    edges = mixing.mix_sources(edge_rows(spark).unionByName(edge_rows(spark)))
    assert set(edges.select(DOCS_COLUMNS).distinct().collect()) <= set(edge_rows(spark).collect()) and edges.filter("doc_id = 4").groupBy("copy").count().filter("count % 4 > 0").isEmpty()
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_pipeline_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.save(stage(spark, rows, SF), "test-stage")
        if k < 4:
            assert out.columns == rows.columns and 0 < out.count() <= rows.count()
            rows = out
    assert corpus_pipeline.run(spark, SF).count() == out.count()
    edges = edge_rows(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edges, SF).count()
        assert stage(spark, docs(spark, []), SF).count() == 0
