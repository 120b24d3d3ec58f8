"""Operator 3: repeated passages by recompression.

Recompression gives equal stretches of words equal symbols inside, wherever
they stand: in each round every maximal run of one symbol gets a name made of
symbol and length, then symbols are split in two halves by their names, and each
pair (first half, second half) gets a name made of both. Names are 64-bit hashes
of what they stand for; so they are global, the same in every task, and a round
needs no exchange and no dictionary. All rounds of a batch run in numpy.

With each symbol goes its support: the words that decide how it was named. Two
equal windows that hold a symbol's whole support both have that symbol. From the
symbols of the last round whose support a window holds, the one of least key (a
hash of its support) is the window's anchor; equal windows have equal anchors. A
window with none (long runs) is its own anchor.

1. Anchors (about one in twelve words) are counted over all texts.
2. Windows with an anchor that occurs twice are candidates. Their hashes are
   counted; those that occur twice, anywhere, are repeats, and no others.
3. Words in a repeated window are removed.

Counts are summed inside tasks first, and what is found goes back to texts by
joins that Spark splits where one key is frequent. Only one of several equal texts
(128 bits) hands in its windows. Windows are equal if two independent hashes of 64
bits are; the second serves the count alone, as within one text the first does.

Defined results: a null, empty or wordless text has no words and the digest of
nothing. Copies of a text of WINDOW words or more lose all words, the first
included. Repeated rows count as copies. Other columns are carried by
remove_repeats(), but for those named like its own (`rep_...`, as it lists).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written
from .words import U64, Windows, Words, mix, pieces, tidy, utf8

WINDOW, ROUNDS = 35, 3
RUN, PAIR, OWNER = U64(0x8CB92BA72F3D8DD7), U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)


def recompress(names: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, and the words (from, to) of each one's support. A support that a text's end cuts reaches beyond it."""
    low = np.arange(len(names))
    high = low + 1
    from_, to, own = low.copy(), high.copy(), owner
    for t in range(rounds):
        # runs; a symbol's neighbours show where its run ends
        edge = np.flatnonzero((names[1:] != names[:-1]) | (own[1:] != own[:-1])) + 1
        head, tail = np.concatenate(([0], edge)), np.concatenate((edge, [len(names)])) - 1
        left, right = np.maximum(head - 1, 0), np.minimum(tail + 1, len(names) - 1)
        new_from = np.where((head > 0) & (own[left] == own[head]), np.minimum(from_[left], from_[head]), low[head] - 1)
        new_to = np.where((tail < len(names) - 1) & (own[right] == own[tail]), np.maximum(to[right], to[tail]), high[tail] + 1)
        size = (tail - head + 1).astype(U64)
        names = np.where(size > 1, mix(names[head] * RUN + size), names[head])
        low, high, own, from_, to = low[head], high[tail], own[head], new_from, new_to
        # pairs; one that stays alone depends on the neighbour it could have had
        first = (mix(names + U64(t + 1)) & U64(1)) == 0
        joined = own[1:] == own[:-1]
        pair = np.append(first[:-1] & ~first[1:] & joined, False)
        second = np.concatenate(([False], pair[:-1]))
        after, before = np.append(joined, False), np.concatenate(([False], joined))
        alone = ~pair & ~second
        next_to, last_from = np.append(to[1:], 0), np.concatenate(([0], from_[:-1]))
        new_to = np.where(alone & first, np.where(after, np.maximum(to, next_to), high + 1), np.where(pair, next_to, to))
        new_from = np.where(alone & ~first, np.where(before, np.minimum(from_, last_from), low - 1), from_)
        new_high = np.where(pair, np.append(high[1:], 0), high)
        names = np.where(pair, mix(mix(names * PAIR) + np.append(names[1:], U64(0))), names)
        keep = ~second
        names, low, high, own, from_, to = names[keep], low[keep], new_high[keep], own[keep], new_from[keep], new_to[keep]
    return names, from_, to


class Anchors:
    """Of each window: its text, hash, anchor key, and a number that is the same for one place of the anchor."""

    def __init__(self, words: Words, window: int = WINDOW):
        hashes = words.hashes()
        windows = Windows(hashes)
        value, owner = windows.every(window), words.text_of()
        self.start = np.flatnonzero(np.arange(len(value)) + window <= words.first[1:][owner[: len(value)]])
        self.text, self.hash = owner[self.start], value[self.start]
        self.key, self.place = mix(self.hash + OWNER), -1 - self.start
        if not len(self.start):
            return
        names, from_, to = recompress(hashes, owner)
        inside = np.flatnonzero((to - from_ <= window) & (from_ >= 0) & (to <= len(hashes)))
        inside = inside[(from_[inside] >= words.first[:-1][owner[np.minimum(from_[inside] + 1, len(owner) - 1)]]) & (owner[np.maximum(from_[inside], 0)] == owner[to[inside] - 1])]
        if not len(inside):
            return
        from_, to = from_[inside], to[inside]
        keys = mix(windows.of(from_, to) ^ mix(names[inside]))
        a, b = np.searchsorted(from_, self.start, "left"), np.searchsorted(to, self.start + window, "right")
        has = b > a
        a, b = a[has], b[has]
        # least key of each window's symbols: the smaller of two overlapping powers of two
        best, levels = np.arange(len(keys)), [np.arange(len(keys))]
        while 2 << (len(levels) - 1) <= int((b - a).max(initial=0)):
            step = 1 << (len(levels) - 1)
            one, two = best[:-step], best[step:]
            best = np.where(keys[one] <= keys[two], one, two)
            levels.append(best)
        level = np.frexp(b - a)[1] - 1
        anchor = np.empty(len(a), np.int64)
        for k, best in enumerate(levels):
            mine = level == k
            one, two = best[a[mine]], best[b[mine] - (1 << k)]
            anchor[mine] = np.where(keys[one] <= keys[two], one, two)
        self.key[has], self.place[has] = keys[anchor], from_[anchor]


def _tally(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct (text, value), and 1 or 2 for once or more."""
    key = mix(value ^ (text.astype(U64) * OWNER))
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else order
    n = np.diff(np.append(first, len(order)))
    return order[first], np.minimum(n, 2)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
        for a, b in pieces(texts):
            found = Anchors(Words(texts[a:b]))
            _, at = np.unique(found.place, return_index=True)
            first, n = _tally(found.text[at], found.key[at])
            at = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(found.key[at].astype(np.int64)), pa.array(refs[a:b][found.text[at]]), pa.array(n.astype(np.int8))], ["key", "ref", "n"])
    tidy()


class _Known:
    """Whether a value is among those listed for its text."""

    def __init__(self, lists: pa.Array):
        offsets = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
        values = lists.flatten().to_numpy().astype(U64)
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, offsets)
        self.sorted = np.sort(mix(values ^ (np.repeat(np.arange(len(lists)), sizes).astype(U64) * OWNER)))

    def has(self, text: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(text), bool)
        key = mix(value ^ (text.astype(U64) * OWNER))
        return self.sorted[np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)] == key


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, text, copies, keys) -> both hashes of the windows whose anchor is among the keys."""
    for batch in batches:
        refs, texts, copies = batch.column(0).to_numpy(), utf8(batch.column(1)), batch.column(2).to_numpy()
        for a, b in pieces(texts):
            words = Words(texts[a:b])
            found = Anchors(words)
            stay = np.flatnonzero(_Known(batch.column(3).slice(a, b - a)).has(found.text, found.key))
            first, n = _tally(found.text[stay], found.hash[stay])
            at = stay[first]
            second = Windows(words.hashes(1)).every(WINDOW)[found.start[at]]
            text = found.text[at]
            yield pa.RecordBatch.from_arrays([pa.array(found.hash[at].astype(np.int64)), pa.array(second.astype(np.int64)), pa.array(refs[a:b][text]), pa.array(np.minimum(n * copies[a:b][text], 2).astype(np.int8))], ["h", "h2", "ref", "n"])
    tidy()


def _removed(clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = utf8(batch.column(1)), batch.column(2)
            for a, b in pieces(texts):
                words = Words(texts[a:b])
                owner, gone = words.text_of(), np.zeros(len(words) + 1, np.int64)
                value = Windows(words.hashes()).every(WINDOW)
                start = np.flatnonzero(np.arange(len(value)) + WINDOW <= words.first[1:][owner[: len(value)]])
                start = start[_Known(lists.slice(a, b - a)).has(owner[start], value[start])]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + WINDOW, -1)
                gone = np.cumsum(gone[:-1]) > 0
                n = np.bincount(owner[gone], minlength=b - a)
                left = []
                for d, text in enumerate(texts[a:b]):
                    kept = (text or b"").split()
                    if n[d]:
                        kept = [w for w, g in zip(kept, gone[words.first[d] : words.first[d + 1]].tolist(), strict=True) if not g]
                    left.append(b" ".join(kept))
                made = [batch.column(0).slice(a, b - a), pa.array(words.count, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                names = ["row", "rep_words", "rep_removed", "rep_sha256"]
                yield pa.RecordBatch.from_arrays(made + [pa.array([x.decode() for x in left])] * clean, names + ["rep_text"] * clean)
        tidy()

    return run


def _ref(text: str) -> Column:
    return F.xxhash64(text)


def repeated_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ref, hashes): for each text with any, the hashes of its windows that also start elsewhere. ref: 64 bits of the text; texts that share one share the list."""
    rows = docs.select(F.col(key).cast("long").alias("id"), _ref(text).alias("ref"), F.xxhash64(F.lit(1), text).alias("ref2"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    anchors = written(rows.select("ref", "text").mapInArrow(_anchors, "key long, ref long, n byte"), "anchors")
    twice = written(anchors.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "anchors-twice")
    found = anchors.join(twice, "key").groupBy("ref").agg(F.collect_set("key").alias("keys"))
    copies = rows.groupBy("ref", "ref2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = written(found.join(copies, "ref").select("ref", "ref2", F.least("n", F.lit(2)).cast("int").alias("copies"), "least", "keys"), "anchored")
    f = found.select(F.col("ref").alias("f"), F.col("ref2").alias("f2"), "copies", "least", "keys")
    windows = rows.join(f, (F.col("ref") == F.col("f")) & (F.col("ref2") == F.col("f2")) & F.col("id").eqNullSafe(F.col("least"))).select("ref", "text", "copies", "keys")
    windows = written(windows.mapInArrow(_candidates, "h long, h2 long, ref long, n byte"), "windows")
    twice = written(windows.groupBy("h", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "h2"), "windows-twice")
    return written(windows.join(twice, ["h", "h2"]).groupBy("ref").agg(F.collect_set("h").alias("hashes")), "repeats")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """`docs` with rep_words, rep_removed, rep_sha256 and, if `clean`, rep_text (the kept words, joined by one space)."""
    hashes = repeated_windows(docs, key=key, text=text).select(F.col("ref").alias("f"), "hashes")
    own = [T.StructField("rep_words", T.LongType()), T.StructField("rep_removed", T.LongType()), T.StructField("rep_sha256", T.StringType())] + [T.StructField("rep_text", T.StringType())] * clean
    names = [c for c in docs.columns if c not in {f.name for f in own}]
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("t"), _ref(text).alias("ref"))
    joined = rows.join(hashes, F.col("ref") == F.col("f"), "left").select("row", "t", "hashes")
    out = joined.mapInArrow(_removed(clean), T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in names])), *own]))
    return out.select("row.*", *[f.name for f in own])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashes = repeated_windows(docs).select(F.col("ref").alias("f"), "hashes")
    joined = docs.withColumn("ref", _ref("text")).join(hashes, F.col("ref") == F.col("f"), "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(_removed(False), "row long, rep_words long, rep_removed long, rep_sha256 string").select(F.col("row").alias("doc_id"), F.col("rep_words").alias("n_words"), F.col("rep_removed").alias("n_removed"), F.col("rep_sha256").alias("kept_sha256"))


#: All windows as joined words, and the words that one with a second start covers.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT r, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM m),
c AS (SELECT r, count(*) AS n FROM g GROUP BY r),
t AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
l AS (SELECT t.r, string_agg(t.x, ' ' ORDER BY t.p) AS left_ FROM t LEFT JOIN g ON g.r = t.r AND g.p = t.p WHERE g.p IS NULL GROUP BY t.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""
