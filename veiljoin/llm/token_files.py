"""Token ids in binary files: byte or bit planes of fixed-size blocks, each plane compressed, with a chunk index.

A file is a row of sections, each followed by one newline byte (Spark's text writer puts it there, so
any Hadoop file system will do and Spark's commit protocol holds):

====================  =====================================================================================
header                magic, shard number, ids a block, bits a plane
id blocks             the planes of ``block`` ids (the last block has fewer), each a zstandard frame
document chunks       planes of document ids, of numbers of ids a document, and a mask of ids that are null
index                 an entry a section: kind, offset, numbers in it, CRC-32 of the numbers, lengths of planes
trailer               offset and length of the index, ids in the file, documents in the file, magic
====================  =====================================================================================

So a reader needs the trailer, the index and the blocks it wants (``TokenFile.ids``). Files in the order
of their shard number hold the documents in ascending order of id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import bound_batches, save, shared_dir, small

MAGIC = b"VJTOKEN1"
HEADER, ENTRY, TRAILER = struct.Struct("<8sQII"), struct.Struct("<BQIIB"), struct.Struct("<QQQQ8s")
IDS, DOC_IDS, COUNTS, NULLS = range(4)
WIDTHS = {IDS: np.dtype("<u4"), DOC_IDS: np.dtype("<u8"), COUNTS: np.dtype("<u8"), NULLS: np.dtype("<u4")}
#: Ids a block, and documents a chunk of the documents' table.
BLOCK = 65_536
#: A file gets about so many bytes of text, more only if a single document is larger.
TEXT_BYTES = 48_000_000
#: Words whose ids a Python worker remembers, of so many bytes with their ids on average; beyond them it keeps those of the last group of texts.
WORDS = 600_000
WORD_BYTES = 48
#: Texts are encoded in groups of about so many bytes; longer ones in pieces that end before a space.
GROUP_CHARS = 8_000_000
LONG_WORD = 64
#: Letters before this one are Latin, and composed in one way only.
LATIN = "\u0250"
#: White space that ends a word becomes a space.
SPACES = bytes(32 if c in b"\t\n\r" else c for c in range(256))


def to_planes(values: np.ndarray, bits: int) -> list[bytes]:
    """Planes of unsigned numbers, the lowest first, up to the highest that isn't all zero: ``bits`` is 1 or 8."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    top = int(values.max()) if len(values) else 0
    if bits == 8:
        return [raw[i].tobytes() for i in range((top.bit_length() + 7) // 8)]
    return [np.packbits((raw[i // 8] >> np.uint8(i % 8)) & np.uint8(1)).tobytes() for i in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, bits: int, dtype: np.dtype) -> np.ndarray:
    raw = np.zeros((dtype.itemsize, n), np.uint8)
    for i, plane in enumerate(planes):
        if bits == 8:
            raw[i] = np.frombuffer(plane, np.uint8)
        else:
            raw[i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(i % 8)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(n)


class Sections:
    """Builds the sections of one file; keeps the index and less than a block of ids."""

    def __init__(self, shard: int, bits: int, block: int) -> None:
        self.shard, self.bits, self.block = shard, bits, block
        self.at, self.entries, self.n_ids, self.n_docs = 0, [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.ids, self.docs = [np.zeros(0, WIDTHS[IDS])], [[np.zeros(0, WIDTHS[k])] for k in (DOC_IDS, COUNTS, NULLS)]

    def section(self, raw: bytes) -> bytes:
        self.at += len(raw) + 1
        return raw

    def header(self) -> bytes:
        return self.section(HEADER.pack(MAGIC, self.shard, self.block, self.bits))

    def numbers(self, kind: int, values: np.ndarray) -> bytes:
        planes = [self.zstd.compress(p) for p in to_planes(values, self.bits)]
        self.entries.append(ENTRY.pack(kind, self.at, len(values), zlib.crc32(values), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        return self.section(b"".join(planes))

    def whole(self, parts: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """What is left over, and the values that fill whole blocks (all of them at the end)."""
        values = np.concatenate(parts)
        cut = len(values) if last else len(values) - len(values) % self.block
        return [values[cut:].copy()], values[:cut]

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, last: bool = False) -> Iterator[bytes]:
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(counts)
        self.ids, ready = self.whole([*self.ids, ids], last)
        for i in range(0, len(ready), self.block):
            yield self.numbers(IDS, ready[i : i + self.block])
        tables = [self.whole([*old, new.astype(WIDTHS[k])], last) for k, old, new in zip((DOC_IDS, COUNTS, NULLS), self.docs, (doc_ids, counts, nulls))]
        self.docs = [rest for rest, _ in tables]
        for i in range(0, len(tables[0][1]), self.block):
            for kind, (_, values) in zip((DOC_IDS, COUNTS, NULLS), tables):
                yield self.numbers(kind, values[i : i + self.block])

    def end(self) -> Iterator[bytes]:
        yield from self.add(*(np.zeros(0, WIDTHS[k]) for k in (DOC_IDS, NULLS, COUNTS, IDS)), last=True)
        at, index = self.at, b"".join(self.entries)
        yield self.section(index)
        yield TRAILER.pack(at, len(index), self.n_ids, self.n_docs, MAGIC)


class TokenFile:
    """Reads one file's bytes by its chunk index; a section whose numbers don't have its CRC-32 raises ValueError."""

    def __init__(self, raw: bytes) -> None:
        self.raw = memoryview(raw)
        magic, self.shard, self.block, self.bits = HEADER.unpack_from(self.raw, 0)
        at, size, self.n_ids, self.n_docs, end = TRAILER.unpack_from(self.raw, len(raw) - TRAILER.size - 1)
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a file of token ids")
        self.sections: dict[int, list[tuple]] = {k: [] for k in WIDTHS}
        stop, self.zstd = at + size, zstandard.ZstdDecompressor()
        while at < stop:
            kind, offset, n, crc, planes = ENTRY.unpack_from(self.raw, at)
            at += ENTRY.size
            self.sections[kind].append((offset, n, crc, struct.unpack_from(f"<{planes}I", self.raw, at)))
            at += 4 * planes

    def numbers(self, kind: int, i: int) -> np.ndarray:
        at, n, crc, lengths = self.sections[kind][i]
        planes = []
        for length in lengths:
            planes.append(self.zstd.decompress(self.raw[at : at + length]))
            at += length
        values = from_planes(planes, n, self.bits, WIDTHS[kind])
        if zlib.crc32(values) != crc:
            raise ValueError(f"section {i} of kind {kind} is damaged")
        return values

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the file from ``start`` up to ``stop`` or its end; only the blocks that hold them are decompressed."""
        stop = min(stop, self.n_ids)
        first, past = start // self.block, -(-stop // self.block)
        found = [self.numbers(IDS, i) for i in range(first, past)]
        return np.concatenate([np.zeros(0, WIDTHS[IDS]), *found])[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of documents, masks of those that are null, and numbers of token ids, a chunk at a time."""
        for i in range(len(self.sections[DOC_IDS])):
            yield self.numbers(DOC_IDS, i).view(np.int64), self.numbers(NULLS, i).astype(bool), self.numbers(COUNTS, i).astype(np.int64)


class TextIds:
    """Token ids of texts, by a tokenizer file of the ``tokenizers`` library.

    ``by_word``: for tokenizers that fold case and drop white space, whose ids of a text are those of its words one
    after the other. A group of texts is cut into words as one array of bytes, also between an ASCII letter and a digit or
    sign if the tokenizer parts them, and becomes a dictionary of its words. Each word is encoded once and remembered, many
    to a call, with NUL between them as its id tells where a word ends. Words that hold NUL or the tokenizer's own control strings
    are encoded alone. Words of Latin letters are normalised many at a time and then only cut at spaces; tokens with the
    suffix of word ends tell where they end. No Python object is made for a word that is remembered.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = [*self.added, "\0"]
        end = self.encode(["\0"])[0]
        self.end = end[0] if len(end) == 1 else None
        self.joins = self.end is not None and self.encode(["AbC."])[0] == sum(self.encode(["abc", "."]), [])
        tails = [c + after for c in map(chr, range(128)) if not c.isalpha() for after in ("", "s", ".", "'")]
        found = self.encode(["abc", *tails, *("aBC" + t for t in tails)])
        self.finer = self.joins and found[1 + len(tails) :] == [found[0] + ids for ids in found[1 : 1 + len(tails)]]
        self.letters, self.ends = Tokenizer(self.tokenizer.model), None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        probe = ["a", "the", "abcdefghijklmnopqrstuvwxyz", "zzqxj", "\u00e9\u00df\u0153\u0180"]
        if suffix and self.joins and self.tokenizer.normalizer and self.encode(probe) == [e.ids for e in self.letters.encode_batch_fast(probe, add_special_tokens=False)]:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words of texts start, and the last one ends: after each space and text, and between an ASCII letter and an ASCII byte that is none.

        Capitals become small in ``data``, where no mark may follow that composes with them. With a control string anywhere, cuts are at spaces only.
        """
        last = data == 32
        if self.finer and not self.controlled(data.tobytes().lower()):
            after = np.append(data[1:], np.uint8(32))
            data += ((data - np.uint8(65) < 26) & (after < 128)).view(np.uint8) * np.uint8(32)
            letter = (data | np.uint8(32)) - np.uint8(97) < 26
            letter[:-1] &= ~letter[1:]
            last |= letter & (after < 128) & (after != 32)
        last[ends[ends > 0] - 1] = True
        starts = np.zeros(np.count_nonzero(last) + 1, np.int32)
        np.add(np.flatnonzero(last), 1, out=starts[1:], casting="same_kind")
        return starts

    def controlled(self, low: bytes) -> bool:
        """Whether small letters may hold a control string, of whatever case."""
        return any(c.lower().encode() in low for c in self.added)

    def of_words(self, texts: pa.StringArray) -> list[bytes]:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if at[0] == at[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(bytearray(texts.buffers()[2][at[0] : at[-1]].to_pybytes().translate(SPACES)), np.uint8)
        at = at - at[0]
        starts = self.cut(data, at[1:])
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        found = self.of_distinct(pc.ascii_rtrim(words.dictionary, " ")).take(words.indices)
        past = np.frombuffer(found.buffers()[1], np.int64)[np.searchsorted(starts, at)].tolist()
        raw = found.buffers()[2] or b""
        return [bytes(memoryview(raw)[i:j]) for i, j in zip(past, past[1:])]

    def of_distinct(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each word, of those that are remembered and those that are learnt now."""
        at = pc.index_in(words, value_set=self.words)
        unknown = pc.is_null(at)
        asked = words.filter(unknown)
        new, ids = self.learn(asked.unique())
        at = pc.replace_with_mask(at, unknown, pc.add(pc.index_in(asked, value_set=new), pa.scalar(len(self.words), pa.int32())))
        every, its = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
        if max(len(every), (every.nbytes + its.nbytes) // WORD_BYTES) > WORDS:
            kept = at.unique()
            kept = kept.filter(pc.less_equal(pc.binary_length(every.take(kept)), LONG_WORD))[:WORDS]
            self.words, self.ids = every.take(kept), its.take(kept)
        else:
            short = pc.less_equal(pc.binary_length(every), LONG_WORD)
            self.words, self.ids = (every, its) if pc.all(short).as_py() in (True, None) else (every.filter(short), its.filter(short))
        return its.take(at)

    def learn(self, words: pa.StringArray) -> tuple[pa.StringArray, pa.LargeBinaryArray]:
        """Words in another order, and their ids. Latin words are known without the punctuation that they end in, which has tokens of its own."""
        if self.ends is None:
            ascii_words, rest = words[:0], words.to_pylist()
        else:
            plain = pc.match_substring_regex(words, f"^[a-z]{{1,{LONG_WORD}}}$")
            for c in [c for c in self.added if c.isalpha()]:
                plain = pc.and_not(plain, pc.match_substring(words, c))
            ascii_words, rest = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        alone = [w for w in rest if not self.joins or len(w) > LONG_WORD or any(c in w for c in self.control)]
        many = set(rest).difference(alone)
        stems = {w: s for w in many if (s := stem(w))[1]} if self.finer and self.ends is not None else {}
        many = many.difference(stems).union(*stems.values())
        latin = [w for w in many if w.isalpha() and max(w) < LATIN] if self.ends is not None else []
        low = self.tokenizer.normalizer.normalize_str(" ".join(latin)).split(" ") if latin else []
        letters = {w: x for w, x in zip(latin, low, strict=True) if x.isalpha() and max(x) < LATIN}
        others = list(many.difference(letters))
        parts = [
            self.in_one(ascii_words.to_pylist(), self.letters), self.in_one(list(letters.values()), self.letters), self.in_one(others, self.tokenizer),
            pa.array([np.array(ids, "<u4").tobytes() for ids in self.encode(alone)], pa.large_binary()),
        ]
        names = [*letters, *others, *alone]
        known = dict(zip(names, pa.concat_arrays(parts[1:]).to_pylist())) if stems else {}
        parts.append(pa.array([known[base] + known[tail] for base, tail in stems.values()], pa.large_binary()))
        extra = set(names).difference(rest) if stems else ()
        every, its = pa.concat_arrays([ascii_words, pa.array([*names, *stems], pa.string())]), pa.concat_arrays(parts)
        if extra:
            asked = pc.is_in(every, value_set=words)
            every, its = every.filter(asked), its.filter(asked)
        return every, its

    def in_one(self, words: list[str], tokenizer: Tokenizer) -> pa.LargeBinaryArray:
        """Encode many words in one text and cut its ids after the tokens that end a word, or at the NUL between words."""
        found = [pa.array([], pa.large_binary())]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            text = (" " if tokenizer is self.letters else " \0 ").join([*some, ""]).rstrip(" ")
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if tokenizer is self.letters:
                past = np.flatnonzero(self.ends[ids]) + 1
            else:
                past = np.flatnonzero(ids == self.end)
                ids, past = np.delete(ids, past), past - np.arange(len(past))
            if len(past) != len(some):
                raise ValueError("tokens don't tell where words end")
            found.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * np.append(0, past)), pa.py_buffer(ids)]))
        return pa.concat_arrays(found)

    def of(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            yield from (np.array(ids, "<u4").tobytes() for text in texts.to_pylist() for ids in self.encode([text]))
            return
        at, past = 0, np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64))
        while at < len(texts):
            to = int(np.searchsorted(past, past[at] + GROUP_CHARS, "right")) - 1
            if to > at:
                yield from self.of_words(texts[at:to])
            else:
                yield b"".join(self.of_words(pa.array([piece]))[0] for piece in pieces(texts[at].as_py()))
            at = max(to, at + 1)


def stem(word: str) -> tuple[str, str]:
    """A word whose small letters are Latin, without marks, and the ASCII punctuation at its end; else all of it."""
    base = word.rstrip(punctuation)
    return (base, word[len(base) :]) if base.lower().isalpha() and max(base) < LATIN else (word, "")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with rows, small ones put together up to ``GROUP_CHARS`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        more = batch.column("text").nbytes
        if held and size + more > GROUP_CHARS:
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.concat_batches(held)


def pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = text.find(" ", at + GROUP_CHARS)
        end = cut if cut >= 0 else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def text_ids(path: str, by_word: bool) -> TextIds:
    """A worker keeps its tokenizer and the words it knows from task to task."""
    return TextIds(path, by_word)


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = False, bits: int = 8, block: int = BLOCK, text_bytes: int = TEXT_BYTES
) -> str:
    """Write the token ids of ``docs`` (doc_id, text) in ascending order of doc_id; returns the folder.

    ``tokenizer`` is the path of a tokenizer file that executors have too; ``end_id`` follows each document. Ids of
    documents must be integers. A null id sorts first, a null text is empty; rows that share an id are all written,
    in the order of a hash of the text, then the text, so repeated rows come out alike in any order. Other columns
    don't matter. Texts are shuffled once, by ranges of (doc_id, hash), and encoded where they are written. An
    empty table gives no files with ids.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-int(size) // text_bytes)), "doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encoder, tail = Sections(TaskContext.get().partitionId(), bits, block), text_ids(tokenizer, by_word), np.array([end_id], "<u4").tobytes()
        send = lambda parts: pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["section"])
        for batch in gathered(batches):
            parts = [out.header()] if not out.n_docs else []
            raw = [ids + tail for ids in encoder.of(batch.column("text"))]
            counts = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
            ids = batch.column("doc_id")
            parts += out.add(
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.asarray(ids.is_null()), counts, np.frombuffer(b"".join(raw), "<u4")
            )
            if parts:
                yield send(parts)
        if out.n_docs:
            yield send(list(out.end()))

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    made = rows.mapInArrow(sections, "section binary").select(F.col("section").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "none").text(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files of ``path``, read by their indexes: doc_id, start, n_tokens, ids_crc32, shard, place.

    ``start`` counts the ids of all documents before it, ``place`` the documents of its file before it. The CRC-32
    is that of its ids as little-endian 32-bit integers, computed block by block.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                yield from told(TokenFile(raw.as_buffer().to_pybytes()))

    def told(file: TokenFile) -> Iterator[pa.RecordBatch]:
        start = place = i = at = 0
        block = memoryview(b"")
        for doc_ids, nulls, counts in file.documents():
            crcs = np.zeros(len(counts), np.int64)
            for d, left in enumerate((4 * counts).tolist()):
                crc = 0
                while left:
                    if at == len(block):
                        block, at, i = memoryview(file.numbers(IDS, i).tobytes()), 0, i + 1
                    some = min(left, len(block) - at)
                    crc, at, left = zlib.crc32(block[at : at + some], crc), at + some, left - some
                crcs[d] = crc
            n = len(counts)
            starts = start + np.cumsum(counts) - counts
            columns = [pa.array(doc_ids, mask=nulls), *map(pa.array, (starts, counts, crcs, np.full(n, file.shard, np.int64), place + np.arange(n)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"])
            start, place = start + int(counts.sum()), place + n

    names = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint, place bigint"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    found = save(files.mapInArrow(documents, names), "token-rows")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = found.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(small(bases), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard", "place")
