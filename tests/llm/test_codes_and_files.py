"""Conversation repair, token files and vector codes against brute force, with their edge cases."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veiljoin.llm import chat_repair, token_files, vector_codes
from veiljoin.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CHATS = "conv_id long, turn long, role string, text string"


def clash(df, names):
    return df.select(*df.columns, *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


# Conversation repair


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.strip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Best first over all edits: the first whole one that comes up is the least by cost, then audit."""
    kinds, heap = faults(rows), [(0, "", 0, ())]
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(out)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        steps = [("I", 3, i, (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            steps.append(("D", 4, i + 1, None))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 * (kinds[i] == "truncated")
                steps += [("K", more, i + 1, rows[i]), *(("R", 3 + more, i + 1, (r, text)) for r in ("user", "assistant"))]
        for letter, price, at, put in steps:
            heapq.heappush(heap, (cost + price, audit + letter, at, out + ((put,) if put else ())))


def test_repairs_are_the_cheapest(spark):
    rng, rows = random.Random(5), []
    for conv in range(250):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "])
            text = rng.choice(["a.", "b?", "c", " \n", "", f"t{turn}.", f"t{turn}! ", "x. "])
            rows.append((conv, turn, role, text))
    got = {r.conv_id: r for r in chat_repair.repair_chats(spark.createDataFrame(rows, CHATS).repartition(5)).collect()}
    assert len(got) == 250
    for conv in range(250):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        kinds, r = faults(own), got[conv]
        assert (r.cost, r.audit, [tuple(t) for t in r.turns]) == cheapest(own), own
        assert [r.blank, r.duplicate, r.truncated] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [role[:1] for role, _ in own]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) and r.gaps == 0


def test_repair_of_nulls_ties_and_empty_tables(spark):
    rows = [
        (1, None, "user", "q?"), (1, 5, "assistant", "a."), (1, 9, None, None), (2, 3, "user", "x."), (2, 3, "user", "x."), (2, 3, "assistant", "y."),
        (None, 0, "user", "q."), (None, 1, "assistant", "a."), (3, None, None, None), (4, 0, "user", "gone."),
    ]
    two = [("assistant", "y."), ("user", "x."), ("user", "x.")]
    df = spark.createDataFrame(rows, CHATS)
    clashing = clash(df, ["place", "here", "fault", "row", "rows", "best", "initial", "fresh", "cost"])
    for d in (df, clashing, clashing.repartition(7)):
        got = {r.conv_id: r for r in chat_repair.repair_chats(d, F.coalesce(F.col("conv_id") != 4, F.lit(True))).collect()}
        assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in got.items()} == {
            1: (3, 1, 0, 0, 1, 4, "KKD"), 2: (0, 0, 1, 0, 1, *cheapest(two)[:2]), None: (0, 0, 0, 0, 0, 0, "KK"), 3: (0, 1, 0, 0, 0, 4, "D"), 4: (0, 0, 0, 0, 0, 0, ""),
        }
        assert got[4].turns == [] and [tuple(t) for t in got[1].turns] == [("user", "q?"), ("assistant", "a.")]
    assert chat_repair.repair_chats(df.limit(0)).count() == 0
    assert (got[2].cost, got[2].audit, [tuple(t) for t in got[2].turns]) == cheapest(two)


def test_repair_of_a_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}." + " " * (1_000_000 if i == 7 else 0)) for i in range(3000)]
    (r,) = chat_repair.repair_chats(spark.createDataFrame(rows[:1500] + rows[1501:], CHATS)).collect()
    assert (r.gaps, r.illegal, r.cost) == (1, 1, 3) and r.audit == "K" * 1500 + "I" + "K" * 1499 and len(r.turns) == 3000


# Token files


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_come_back(bits):
    rng = np.random.default_rng(3)
    for dtype, top in (("<u4", 49408), ("<u4", 2**32 - 1), ("<u8", 2**64 - 1), ("<u4", 0)):
        for n in (0, 1, 7, 8, 1000):
            values = rng.integers(0, top, n, dtype=np.dtype(dtype).newbyteorder("="), endpoint=True).astype(dtype)
            planes = token_files.to_planes(values, bits)
            assert len(planes) <= top.bit_length() and (token_files.from_planes(planes, n, bits, np.dtype(dtype)) == values).all()


TEXTS = [
    "Hello hello HELLO hello. hello, it's It's. a...b 3.14 ,. . , .", "a\x00b \x00 <|endoftext|> x<|startoftext|>y", "tab\tnew\nline\rfeed\x0b\x0c\x1c\x85\xa0 end", "É é É é. J̌ ẞß ΣΑΣ İ İ",
    "", None, "漢字 かな 한국어. 👩‍👩‍👧", "w" * 70 + " " + "w" * 5000, "  spaces   in  rows  ", '" \'s "\'re \x7f ’s don’t.',
]


def expected(rows):
    encoder, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc_id, text in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("by_word,bits", [(True, 8), (True, 1), (False, 8)])
def test_token_files_round_trip(spark, by_word, bits, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_CHARS", 500)
    rows = [(i * 7 - 30, t) for i, t in enumerate(TEXTS * 12)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), ["tie", "section", "value", "start", "shard"])
    path = token_files.write_tokens(df.repartition(6), TOKENIZER, 1, by_word, bits, block=64, text_bytes=4000)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected(rows) and len({r.shard for r in got}) > 3
    folder = path.removeprefix("file:")
    whole = []
    for raw in sorted((open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder) if f.startswith("part-")), key=lambda r: token_files.TokenFile(r).shard if r else -1):
        if raw:
            file = token_files.TokenFile(raw)
            whole += file.ids(0, file.n_ids).tolist()
            assert file.ids(70, 131).tolist() == file.ids(0, file.n_ids)[70:131].tolist()
            at = file.sections[token_files.IDS][0][0] + 12
            broken = token_files.TokenFile(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
            with pytest.raises(Exception):
                broken.numbers(token_files.IDS, 0)
    encoder = Tokenizer.from_file(TOKENIZER)
    assert whole == [i for _, t in rows for i in [*encoder.encode(t or "", add_special_tokens=False).ids, 1]]


def test_token_files_of_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "b"), (3, "x"), (3, "x"), (3, None), (1, "one two"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [[tuple(r)[:4] for r in token_files.read_tokens(spark, token_files.write_tokens(d, TOKENIZER, 1, True)).orderBy("start").collect()] for d in (df, df.repartition(4))]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [None, None, 1, 3, 3, 3]
    assert sorted(r[2:] for r in runs[0]) == sorted(r[2:] for r in expected(rows))
    empty = token_files.read_tokens(spark, token_files.write_tokens(df.limit(0), TOKENIZER, 1, True))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_words_that_are_forgotten_and_stems(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 40)
    texts = [t or "" for t in TEXTS] * 3 + [" ".join(f"Word{i}." for i in range(200))]
    encoder = Tokenizer.from_file(TOKENIZER)
    got = [np.frombuffer(raw, "<u4").tolist() for raw in token_files.TextIds(TOKENIZER, True).of(texts)]
    assert got == [encoder.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_query_equals_whole_encoding(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert [tuple(r) for r in QUERIES["op12_token_files"](spark, SF).orderBy("doc_id").collect()] == expected(rows)


# Vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """Lists of Python integers, one distance at a time."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    vectors = [[math.floor(scale * x) for x in r[1]] for r in good]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, vectors[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        chosen = [[near(c[p], books[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, at in zip(cut, chosen[p]) if at == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    labels = {}
    for r, d in zip(good, last):
        labels[r[2]] = labels.get(r[2], 0) + sum(x for x, _ in d)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in d), sum(x for x, _ in d), labels[r[2]]) for r, d in zip(good, last)], sha


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_plain_arithmetic(spark):
    rng = random.Random(8)
    rows = [(i // 2 if i % 9 == 0 else i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)], rng.choice([0, 1, 2, None])) for i in range(300)]
    rows += [rows[5]] * 40 + [(None, rows[6][1], 1), (-4, None, 1), (-3, [1.0, None] * 4, 1), (-2, [float("nan")] * 8, 1), (-1, [float("-inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    want, sha = plain_codes(rows, 4, 16, 4, 1024)
    for d in (df.repartition(5), clash(df, ["v", "code", "error", "same", "part", "entry", "n", "s0"]).coalesce(1)):
        coded, books = vector_codes.vector_codes(d, entries=16)
        assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=str) == sorted(want, key=str)
        assert books.sha256() == sha


def test_codes_of_few_rows_ties_and_none(spark):
    rows = [(2, [0.0] * 4, None), (1, [0.0] * 4, None), (3, [1.0] * 4, None)]
    coded, books = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS))
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0), (3, "02020202", 0, 0)]
    assert books.entries.shape == (4, 3, 1)
    empty, books = vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert empty.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    hollow, _ = vector_codes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [], 1)], VECTORS))
    assert sorted((r.vec_id, r.code, r.error) for r in hollow.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    for bad in ([1.0] * 6, [1e30] * 4):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(spark.createDataFrame([(1, bad, 1)], VECTORS))


def test_distances_are_exact_integers():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(2**28), 2**28, (50, 4)), rng.integers(-(2**28), 2**28, (9, 4))
    assert vector_codes.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in c] for r in x]
