"""Token ids by words: what the library is asked for, cuts inside words, and what is remembered."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from veiljoin.llm import token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    """A tokenizer that counts the characters it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def whole(texts):
    return [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch_fast(texts, add_special_tokens=False)]


def by_word(encoder, texts):
    return [np.frombuffer(raw, "<u4").tolist() for raw in encoder.of(texts)]


def test_words_are_encoded_once_whatever_follows_them():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß", k=12)) for _ in range(400)]
    texts = [" ".join(w + tail for w in words) for tail in ("", ".", ",", "!", "?", "###", "$$$", "&&&", "***", ".)")]
    encoder = token_files.TextIds(TOKENIZER, True)
    encoder.tokenizer, encoder.letters = Counted(encoder.tokenizer), Counted(encoder.letters)
    assert by_word(encoder, texts) == whole(texts)
    assert encoder.tokenizer.chars + encoder.letters.chars < 2 * len(texts[0])
    before = encoder.tokenizer.chars + encoder.letters.chars
    assert by_word(encoder, texts[::-1]) == whole(texts[::-1])
    assert encoder.tokenizer.chars + encoder.letters.chars == before


def test_cuts_inside_words(monkeypatch):
    parts = [*"abJKstSLx.,'\"!_-<|>=19 \n\x0b\x1c\x00\x7f", "é", "É", "ß", "̌", "́", "̸", "̣", "İ", "ǰ", "ſ", "K", "\xa0"]
    parts += ["ͅ", "​", "…", "’", "ª", "²", "漢", "⃣", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "n't"]
    rnd = random.Random(5)
    texts = ["İ_", "Éİ-", "J̌.", "≮", "a≮b", "x<|ENDOFTEXT|>y", "x<|endoftext|>Y.", "don't.'S", "", " ", "A"]
    texts += ["".join(rnd.choices(parts, k=rnd.choice([2, 3, 5, 9, 60]))) for _ in range(4000)]
    monkeypatch.setattr(token_files, "GROUP_CHARS", 90)
    encoder = token_files.TextIds(TOKENIZER, True)
    assert by_word(encoder, texts) == whole(texts)
    assert by_word(encoder, pa.array(["x", *texts], pa.large_string())[1:]) == whole(texts)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 50)
    encoder = token_files.TextIds(TOKENIZER, True)
    for n in range(6):
        texts = [" ".join(f"W{chr(97 + i % 26)}{'xyz'[n % 3] * (i // 26)}é" for i in range(40 * n)), "v" * 65, "w" * 5000]
        assert by_word(encoder, texts) == whole(texts)
        assert len(encoder.words) == len(encoder.ids) <= 50 and "v" * 65 not in encoder.words.to_pylist()


def test_small_batches_are_put_together(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_CHARS", 100)
    sizes = [(0, 0), (2, 10), (1, 30), (0, 0), (1, 500), (3, 0)]
    batches = [pa.record_batch([pa.array([i] * k, pa.int64()), pa.array(["x" * n] * k, pa.string())], ["doc_id", "text"]) for i, (k, n) in enumerate(sizes)]
    got = list(token_files.gathered(iter(batches)))
    assert [b.num_rows for b in got] == [3, 1, 3] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
