"""Operator 10: benchmark decontamination.

A hash set of the benchmark's normalised n-grams is broadcast; tasks scan the
token windows of each training text against it, verify each hit on its bytes,
and mark the words inside. The set is a block of at most `block_chars` of
normalised benchmark text: sorted hashes, offsets into one buffer of words, and
item numbers, some HELD_BYTES a character. A larger benchmark takes several passes
over the texts, each with a block of its own, which is written and whose broadcast
is destroyed before the next; so no task ever holds two. An item longer than a
block is dealt to several, which overlap by a window less one word.

Defined results: a null, empty or wordless text has 0 words and is never
contaminated. A null benchmark text, or one without words, has no window. An
item shorter than the window is one window. A null item_id counts as "null".
Repeated items count once (by item_id). Extra columns of `docs` are carried as
they are, but for those named like the operator's own (`hit_...`, as listed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written
from .words import U64, Windows, Words, pieces, tidy, utf8

WINDOW = 13
#: Bytes of normalised benchmark text in one broadcast block, and what a block holds for each at most (words of one letter), about.
BLOCK_CHARS, HELD_BYTES = 4_000_000, 24

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after A-Z became lower case.
KEEP = np.zeros(256, bool)
KEEP[0x30:0x3A] = KEEP[0x61:0x7B] = KEEP[0x80:] = True
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if KEEP[b] else 0x20 for b in range(256))


class Block:
    """Words of benchmark items, gathered up to a size."""

    def __init__(self, window: int):
        self.window, self.buffer, self.names = window, bytearray(), {}
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def add(self, item: str, words: Words, first: int, last: int) -> None:
        """Windows of the words first to last - 1."""
        size = min(last - first, self.window)
        hashes = Windows(words.hashes()[first:last]).every(size)
        lengths = words.end[first:last] - words.start[first:last] + 1
        start = len(self.buffer) + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.buffer += words.span(first, last) + b" "
        number = self.names.setdefault(item, len(self.names))
        end = start + lengths - 1
        self.parts.setdefault(size, []).append((hashes, start[: len(hashes)].astype(np.uint32), end[size - 1 :].astype(np.uint32), np.full(len(hashes), number, np.uint32)))


class NgramSet:
    """Windows by length: sorted distinct hashes, where each one's words are in the buffer, and the items that have it."""

    def __init__(self, block: Block):
        self.buffer, self.names = bytes(block.buffer), list(block.names)
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        for size in list(block.parts):
            hashes, start, end, item = (np.concatenate(x) for x in zip(*block.parts.pop(size), strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, start, end, item = hashes[order], start[order], end[order], item[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            for i in np.flatnonzero(~new).tolist():  # windows of one hash are the same words, or stand apart
                new[i] = self._words(start[i], end[i]) != self._words(start[i - 1], end[i - 1])
            at = np.flatnonzero(new)
            bits = max(12, int(len(at)).bit_length() + 3)
            near = np.zeros(1 << bits, bool)
            near[(hashes >> U64(64 - bits)).astype(np.int64)] = True
            self.sizes[size] = (hashes[at], start[at], end[at], np.append(at, len(item)), item, near)

    def _words(self, start: int, end: int) -> bytes:
        return self.buffer[start:end]

    def held(self) -> int:
        return len(self.buffer) + sum(x.nbytes for arrays in self.sizes.values() for x in arrays)

    def hits(self, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, size, item numbers) of each window that occurs, verified."""
        if not self.sizes or not len(words):
            return
        windows, last = Windows(words.hashes()), np.repeat(words.first[1:], words.count)
        for size, (hashes, start, end, groups, item, near) in self.sizes.items():
            found = windows.every(size)
            at = np.flatnonzero(near[(found >> U64(64 - int(len(near)).bit_length() + 1)).astype(np.int64)])
            at = at[at + size <= last[at]]
            place = np.searchsorted(hashes, found[at])
            inside = np.flatnonzero(place < len(hashes))
            inside = inside[hashes[place[inside]] == found[at[inside]]]
            for i, g in zip(at[inside].tolist(), place[inside].tolist(), strict=True):
                own = words.span(i, i + size)
                while g < len(hashes) and hashes[g] == found[i]:
                    if self._words(start[g], end[g]) == own:
                        yield i, size, item[groups[g] : groups[g + 1]]
                    g += 1


def blocks(items: Iterable[tuple[str, bytes]], window: int, block_chars: int) -> Iterator[NgramSet]:
    """Sets of the items' windows, one (empty, if need be) at least."""
    block, some = Block(window), False
    for item, text in items:
        words, first = Words([text], KEEP, FOLD), 0
        while first < len(words):
            room = max(block_chars - len(block.buffer), 1)
            last = int(np.searchsorted(words.end, words.start[first] + room, "right"))
            last = min(len(words), max(last, first + window))
            block.add(item, words, first, last)
            if len(block.buffer) >= block_chars or last < len(words):
                yield NgramSet(block)
                block, some = Block(window), True
            if last == len(words):
                break
            first = last - window + 1
    if block.parts or not some:
        yield NgramSet(block)


def _scan(ngrams, names: list[str], text: str, schema: T.StructType, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: NgramSet = ngrams.value
        for batch in batches:
            field = batch.schema.get_field_index
            column = batch.column(field(text))
            texts = utf8(column)
            before, items_before = batch.column(field("hit_spans")), batch.column(field("hit_items"))
            for a, b in pieces(texts):
                words = Words(texts[a:b], KEEP, FOLD)
                edges: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                owner = words.text_of()
                for i, size, found in known.hits(words):
                    d = int(owner[i])
                    low = i - int(words.first[d])
                    edges.setdefault(d, []).append((low, low + size))
                    items.setdefault(d, set()).update(found.tolist())
                spans, names_found, n_hit, left = [], [], [], []
                for d in range(b - a):
                    old = before[a + d].as_py()
                    merged: list[int] = []
                    for low, high in sorted([*zip(old[::2], old[1::2], strict=True), *edges.get(d, ())]):
                        if merged and low <= merged[-1]:
                            merged[-1] = max(merged[-1], high)
                        else:
                            merged += [low, high]
                    spans.append(merged)
                    n_hit.append(sum(merged[1::2]) - sum(merged[::2]))
                    names_found.append(sorted({*items_before[a + d].as_py(), *(known.names[x] for x in items.get(d, ()))}))
                    if cut:
                        left.append(_without(texts[a + d], words, d, merged))
                made = {"hit_words": pa.array(words.count, pa.int64()), "hit_n": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, arrow.field("hit_spans").type), "hit_items": pa.array(names_found, arrow.field("hit_items").type)}
                if cut:
                    made["hit_left"] = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(field(n)).slice(a, b - a) for n in names], schema=arrow)
        tidy()

    return run


def _without(text: bytes | None, words: Words, d: int, spans: list[int]) -> str | None:
    """The text less the bytes from the first to the last word of each span."""
    if text is None or not spans:
        return None if text is None else text.decode()
    base, low = int(words.text_start[d]), int(words.first[d])
    out, at = [], 0
    for i, j in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : int(words.start[low + i]) - base])
        at = int(words.end[low + j - 1]) - base
    return b"".join([*out, text[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, cut_spans: bool = False) -> DataFrame:
    """`docs` with hit_words, hit_n, hit_spans (word ranges, flat), hit_items, hit_contaminated and, if asked, hit_left (the text without the spans)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("t")).filter(F.col("t").isNotNull())
    own = ["hit_words", "hit_n", "hit_spans", "hit_items", *["hit_left"] * cut_spans]
    carried = [c for c in docs.columns if c not in {*own, "hit_contaminated"}]
    names = carried + own
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("hit_words", T.LongType()), T.StructField("hit_n", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType()))] + [T.StructField("hit_left", T.StringType())] * cut_spans)
    out = docs_ = docs.select(*carried, F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    rows = ((r["item"], r["t"].encode()) for r in items.toLocalIterator())
    sets = blocks(rows, window, block_chars)
    known = next(sets)
    while known is not None:
        held = spark.sparkContext.broadcast(known)
        scanned, following = out.mapInArrow(_scan(held, names, text, schema, cut_spans), schema), next(sets, None)
        if following is None and out is docs_:
            out = scanned  # one block: its pass stays part of the plan
        else:
            out = written(scanned, "scanned")
            held.destroy()
        known = following
    return out.withColumn("hit_contaminated", (F.col("hit_n") > 0) & (20 * F.col("hit_n") >= F.col("hit_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return scanned.select("doc_id", F.col("hit_words").alias("n_words"), F.col("hit_n").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), F.col("hit_contaminated").alias("contaminated"))


#: Windows of the benchmark, then of the documents, as joined words.
OP10_SQL = r"""
WITH it AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hits AS (
  SELECT DISTINCT r, i, g.size, g.item
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size) d
  JOIN grams g ON g.size = d.size AND g.gram = array_to_string(d.w[d.i:d.i + d.size - 1], ' ')),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""
