"""Chat, near, exact and substring dedup and decontamination: clashing columns, very long texts, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from veiljoin.llm import chat, common, decontaminate, exact_dedup, mixing, near_dedup, substring_dedup
from veiljoin.llm.queries import QUERIES

#: Names that the operators use for columns of their own.
NAMES = (
    "id doc key text_key class_id class_key kept rep root a b n bands band value token light rest weight probe odd whole also hits items spans "
    "n_words n_hit contaminated removed gone anchor content first low h norm sha keep_id group_size text_sha256 texts copy count rate times hot t r0"
).split()
SHARED = " ".join(f"s{i}" for i in range(70))
ROWS = [
    (1, SHARED + " one"), (2, SHARED + " two"), (2, SHARED + " two"), (3, "short"), (4, ""), (5, None), (6, " ".join(f"w{i % 9001}" for i in range(200_000))), (7, "short"),
    (None, SHARED + " one"),
]
BENCHMARK = [(10, "S3 s4 S5"), (11, None), (12, "short")]


def with_names(df, names=NAMES):
    return df.select(*df.columns, *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names) if c not in df.columns])


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "operator",
    [
        near_dedup.near_classes, exact_dedup.exact_dedup, substring_dedup.remove_repeats,
        lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame(BENCHMARK, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "items", "contaminated", "spans"),
        lambda d: decontaminate.decontaminate(d, with_names(d.sparkSession.createDataFrame(BENCHMARK, "item_id long, text string")), block_chars=4).select(
            "doc_id", "n_words", "n_hit", "items", "contaminated", "spans"
        ),
    ],
)
def test_clashing_columns_change_nothing(spark, operator):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = told(operator(df))
    assert len(want) == len(ROWS)
    assert told(operator(with_names(df))) == want


def test_verdicts_of_long_and_repeated_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert cut[1].removed == [] and cut[2].text == "two" and cut[6].n_words == 200_000 and cut[6].text == ROWS[6][1] and cut[None].text == ""
    near = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 3, None: None}
    found = told(decontaminate.decontaminate(df, spark.createDataFrame(BENCHMARK, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "items"))
    hit = {1: (71, 3, [10]), 2: (71, 3, [10]), 3: (1, 1, [12]), 4: (0, 0, []), 5: (0, 0, []), 6: (200_000, 0, []), 7: (1, 1, [12]), None: (71, 3, [10])}
    assert found == sorted(((i, *hit[i]) for i, _ in ROWS), key=str)


def test_chats_with_ties_repeated_rows_and_long_texts(spark):
    long = "</s>[INST] é\\" * 100_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (2, 0, "user", "q"), (2, 1, "assistant", long), (None, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = lambda d: {r.conv_id: r for r in chat.format_chats(d).select("*", chat.read_chats(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("t")).collect()}
    got = read(df)
    assert [(t.role, t.text) for t in got[1].turns] == [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")] and not got[1].valid
    assert got[2].valid and got[2].t == long and got[2].turns[1].text == long
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "")] and got[None].t == ""
    clashing = with_names(df, ["turns", "segments", "formatted", "valid", "state", "loss"]).repartition(3)
    assert read(clashing) == got


def test_mixing_copies_whole_rows(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 5 == 0 else f"t{i % 3}", "ab"[i % 2] if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = told(mixing.mix_sources(df).select("doc_id", "text", "source"))
    assert out == told(mixing.mix_sources(df.repartition(5)).select("doc_id", "text", "source"))
    assert set(out) <= set(rows) and 150 < len(out) < 450


def test_thirteen_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_text_that_repeats_itself_is_cut_in_bounded_blocks(spark, monkeypatch):
    words = ["same"] * 20_000
    texts = [" ".join(x) for x in (words, words[:300], ["a", "b", "c"] * 2_000, ["c", "a", "b"] * 700, words[:49], ["x", *words[:90], "y"])]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rolling, hashes = common.Rolling(substring_dedup.BASE), common.WordHashes()
    _, _, first, n = substring_dedup.doc_blocks(hashes.of([b"same"] * 20_000), rolling, 50)
    assert n.max() == substring_dedup.BLOCK_WINDOWS and n.sum() == 20_000 - 49 and (first[1:] == (first + n)[:-1]).all()
    for size in (substring_dedup.BLOCK_WINDOWS, 7):
        monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", size)
        seen, out = set(), {r.doc_id: r for r in substring_dedup.remove_repeats(rows).collect()}
        for k, text in enumerate(texts):
            w = text.split()
            windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
            gone = [False] * len(w)
            for i, x in enumerate(windows):
                if x in seen:
                    gone[i : i + 50] = [True] * 50
            seen |= set(windows)
            assert out[k].text == " ".join(x for x, g in zip(w, gone) if not g) and out[k].n_words == len(w)
