"""Operator 7: token ids in fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A chunk is

    4 bytes "CLB1" | u8 bits | 3 zero bytes | u32 documents | u32 blocks | u64 ids
    documents x (i64 doc_id, u8 has id) | documents x u64 ids | (blocks + 1) x u64 byte offsets | data

in little-endian order. Ids lie end to end, lowest bit first; a block is
BLOCK_IDS of them, so that it begins on a byte, and the offsets allow one to be
read without the others. Unpacking is numpy over whole blocks.

Documents are dealt by ranges of doc_id; each task streams its sorted rows into
chunks of about CHUNK_IDS ids, one after the other in a file of its own in the
shared folder. The table of chunks (file, place) that Spark commits tells which
files count, so that a task may fail and be repeated. A reader seeks: it takes the
header and offsets of a chunk, and of its data the blocks that it needs. The place
of a shard in the whole sequence is a running sum over one row a shard.

Defined results: a null or empty text has only the end id. Null doc_ids come
first; repeated ids are in a fixed order by text. An empty table has no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import own_dir, table, written
from .words import pieces, tidy, utf8

MAGIC, HEADER = b"CLB1", struct.Struct("<4sB3xIIQ")
#: Ids of a block and, about, of a chunk; chunks that one task reads.
BLOCK_IDS, CHUNK_IDS, TASK_CHUNKS = 1024, 1 << 19, 32
END_ID = 2
#: Words whose ids a worker keeps, at most twice as many, and the longest of them in bytes.
KEEP_WORDS, KEEP_BYTES = 400_000, 48
#: Normalizers, and pre-tokenizers with their patterns, for which Encoder may go by words.
BUILD = (["NFC", "Replace", "Lowercase"], [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)])
#: Marks that are a piece of their own after a letter or digit.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 64 * BLOCK_IDS):
        part = ids[i : i + 64 * BLOCK_IDS].astype(np.uint32)
        rows = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)))
    at = np.arange(n, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_chunk(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    n_blocks = -(-len(ids) // BLOCK_IDS)
    data = pack(ids, bits)
    offsets = np.minimum(np.arange(n_blocks + 1, dtype="<u8") * (BLOCK_IDS * bits // 8), len(data)).astype("<u8")
    keys = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("has", "u1")]))
    keys["id"], keys["has"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids]
    return b"".join((HEADER.pack(MAGIC, bits, len(doc_ids), n_blocks, len(ids)), keys.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.tobytes(), data))


class Chunk:
    """A chunk, read back: whole, by document, or any range of ids. read(at, size) gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        magic, self.bits, n_docs, n_blocks, self.n_ids = HEADER.unpack(read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a chunk")
        self.read, key = read, np.dtype([("id", "<i8"), ("has", "u1")])
        rest = read(HEADER.size, n_docs * (key.itemsize + 8) + 8 * (n_blocks + 1))
        keys = np.frombuffer(rest, key, n_docs)
        self.doc_ids = [int(k) if has else None for k, has in zip(keys["id"], keys["has"], strict=True)]
        self.lengths = np.frombuffer(rest, "<u8", n_docs, keys.nbytes).astype(np.int64)
        self.offsets = np.frombuffer(rest, "<u8", n_blocks + 1, keys.nbytes + 8 * n_docs).astype(np.int64)
        self.data = HEADER.size + len(rest)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first .. last - 1, from the blocks that hold them only."""
        last = self.n_ids if last is None else last
        if last <= first:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK_IDS, -(-last // BLOCK_IDS)
        n = min(b * BLOCK_IDS, self.n_ids) - a * BLOCK_IDS
        low, high = int(self.offsets[a]), int(self.offsets[b])
        return unpack(self.read(self.data + low, high - low), n, self.bits)[first - a * BLOCK_IDS : last - a * BLOCK_IDS]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


@contextmanager
def opened(file: str) -> Iterator[Callable[[int], Chunk]]:
    """A token file: gives the chunk at a place."""
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(file)
    with system.open_input_file(path) as held:
        yield lambda at: Chunk(lambda offset, size: held.read_at(size, at + offset))


class Recent(dict):
    """Values by key, made where missing. What was not asked for during one whole filling goes."""

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEEP_BYTES:
            self[key] = value
        return value

    def turn(self) -> None:
        """To be called now and then: starts a new filling when this one is full."""
        if len(self) > KEEP_WORDS:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Whole texts by way of their words.

    The tokenizer drops white space and none of its pieces crosses it, so that
    a text's ids are those of its words in order. An ASCII word is lower case
    for it, and marks at its end are a piece of their own (an apostrophe may not
    be, nor may the names of special tokens); so stems and marks are looked up
    apart where the word is new, and a stem of letters below U+0100 goes straight
    to the library's BPE model. Ids of recent words and stems are kept. All this
    holds for tokenizers of this build only (checked from the file); any other one
    encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Recent(self.word), Recent(self.part)
        with open(path, encoding="utf-8") as file:
            build = json.load(file)
        self.by_words = [x["type"] for x in (build["normalizer"] or {}).get("normalizers", [])] == BUILD[0] and [(x["type"], x.get("pattern", {}).get("Regex")) for x in (build["pre_tokenizer"] or {}).get("pretokenizers", [])] == BUILD[1]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha() and chr(i) == chr(i).lower()}
        self.model = self.tokenizer.model

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        self.words.turn()
        self.parts.turn()
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.split())) for t in texts]

    def word(self, word: bytes) -> bytes:
        stem, marks = self.cut(word)
        return self.parts[stem] + self.parts[marks] if marks else self.parts[stem]

    @staticmethod
    def cut(word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(MARKS)
        if b"<|" in word:
            return word, b""
        if stem.isascii():
            return (stem.lower(), word[len(stem) :]) if stem[-1:].isalnum() else (word, b"")
        text = stem.decode()
        return (text.lower().encode(), word[len(stem) :]) if text.isalpha() and max(text) < "\u0100" else (word, b"")

    def part(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isalpha() and max(text) < "\u0100" and text == text.lower():
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text.translate(self.letters))])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


CHUNKS = "shard int, chunk int, first long, n_ids long, file string, at long, size long"


def _writer(path: str, end_id: int, folder: str):
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        bits, end = bits_for(encoder.tokenizer.get_vocab_size(True)), np.array([end_id], "<u4").tobytes()
        shard, file = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.bin"
        system, where = FileSystem.from_uri(file)
        rows: list[tuple] = []
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = first = at = 0
        out = None

        def close() -> None:
            nonlocal out, size, first, at
            if out is None:
                out = system.open_output_stream(where)
            lengths = [len(x) // 4 for x in held]
            raw = write_chunk(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"), bits)
            out.write(raw)
            rows.append((shard, len(rows), first, size, file, at, len(raw)))
            first, at, size = first + size, at + len(raw), 0
            doc_ids.clear()
            held.clear()

        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0).to_pylist()
            for a, b in pieces(texts):
                for key, ids in zip(keys[a:b], encoder.encode([t or b"" for t in texts[a:b]]), strict=True):
                    doc_ids.append(key)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= CHUNK_IDS:
                        close()
        if held:
            close()
        tidy()
        if out is not None:
            out.close()  # all of it is there before the chunks are told
            columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, first, file, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            with opened(file) as chunk_at:
                chunk = chunk_at(at)
                data = memoryview(chunk.ids().astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.starts[:-1] + first, pa.int64()), pa.array(chunk.lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "begin", "n_tokens", "ids_crc32"])
    tidy()


def write_ids(docs: DataFrame, path: str, *, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Token files of all `docs` (doc_id, text) in ascending doc_id order in `folder` (by default one of the session's), and the written table of their chunks (CHUNKS)."""
    folder = own_dir(docs.sparkSession, "ids") if folder is None else folder
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(_writer(path, end_id, folder), CHUNKS), "chunks")


def read_ids(chunks: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32, from the files."""
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # the table is small, what it names is not: some chunks a task, on all cores at least
    tasks = max(1, chunks.count() // TASK_CHUNKS, chunks.sparkSession.sparkContext.defaultParallelism)
    read = chunks.select("shard", "first", "file", "at").repartition(tasks, "file", "at").mapInArrow(_reader, "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return read.join(before, F.col("shard") == F.col("s")).select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), tokenizer_path()))
