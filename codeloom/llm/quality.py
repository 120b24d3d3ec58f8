r"""Operator 1: quality rules with n-gram perplexity.

Language model: n-grams of bytes (ORDER of them), one model a language, by
modified Kneser-Ney smoothing.

1. Tasks count the highest order's n-grams of all texts (numpy), Spark sums them.
   An n-gram is its bytes in a long, so that prefixes and suffixes are shifts.
2. DataFrame operations derive continuation counts of the lower orders, the
   counts of counts and with them the three discounts of each order, each
   context's total, and the interpolated probabilities.
3. An n-gram stays in the model if it occurs LEAST times (else a text would be its
   own proof), whatever the size of the corpus or the number of languages; what
   others had goes to their context's back-off weight, so that each context still
   sums to one.
4. Each n-gram of the texts has been counted, so its bits are worked out once, by
   DataFrame operations. The table is dealt by the first bits of 64-bit hashes to
   shards of about SHARD_ROWS rows, sorted files in the shared folder; nothing of
   it goes to the driver. A task holds CACHE_BYTES of shards at most: a larger
   model is read shard by shard for each piece of text.

Perplexity is taken over the bytes that are not symbols of markup (SYMBOL): what a
symbol costs counts, but it doesn't lengthen the text, so that text strewn with
predictable symbols doesn't pass for easy text.

Verdict: a document is rejected if a base rule fails, or if the logarithm of its
perplexity under its own language's model lies outside the language's band,
REACH interquartile ranges beyond the quartiles of all the language's documents
that pass the base rules. The reach is wider for short texts, whose mean varies
more: the interquartile range counts as at least SHORT / sqrt(bytes). No label is
read when the operator runs.

Defined results: a null or empty text has zeros everywhere, fails the base rules
and has a null perplexity. A null language is a language of its own. Repeated
rows are judged alike. Columns of `docs` named in `carry` are carried, unless
they are named like one of the operator's own (MADE).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written
from .words import NOT_SPACE, U64, Windows, Words, mix, pieces, tidy, utf8

ORDER = 5
LEAST = 2
#: Rows of a shard of the model, and bytes of shards that a task holds at once.
SHARD_ROWS, CACHE_BYTES = 1 << 20, 96 << 20
REACH, SHORT = 3.0, 2.0
#: Steps of a bit on which quartiles are found, and bits above which scores count as one.
GRID, MOST = 1 << 12, 64
#: So many languages or fewer are joined by a broadcast.
FEW_LANGS = 1 << 12
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 18
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Before each text: bytes that stand for its beginning.
PAD = b"\n" * (ORDER - 1)


def ngrams(texts: list[bytes], extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, and the texts' sizes."""
    data = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(U64)
    gram = data[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        gram |= data[ORDER - 1 - k : len(data) - k] << U64(8 * k)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + len(PAD)) - len(PAD)
    inside = np.ones(len(gram), bool)
    for e in ends[:-1].tolist():
        inside[e : e + len(PAD)] = False
    return gram[inside], sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(at.reshape(-1), np.concatenate([p[1] for p in parts])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        for a, b in pieces(texts):
            for lang in set(langs[a:b]):
                mine = [t for t, k in zip(texts[a:b], langs[a:b], strict=True) if k == lang and t]
                if not mine:
                    continue
                grams = np.sort(ngrams(mine)[0])
                first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                parts = held.setdefault(lang, [])
                parts.append((grams[first], np.diff(np.append(first, len(grams)))))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD // 2:
                    yield from out()
                    held = {}
    yield from out()
    held.clear()
    tidy()


def count(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) of all texts, highest order."""
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame, log2_size: int | None = None, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """(lang, m, gram, p, stays) of all counted n-grams, a table an order from 0 to ORDER, and (lang, m, ctx, total, gamma) of all contexts.

    With `log2_size`, n-grams rarer than languages / 2**log2_size don't stay either; by default all do that occur `least` times.
    """
    named = counts.select(F.coalesce("lang", F.lit("")).alias("lang"), "gram", "n")
    # c: what the order's probabilities come from; r: how often it occurs
    now = written(named.groupBy("lang", "gram").agg(F.sum("n").alias("c")).select("lang", F.lit(ORDER).alias("m"), "gram", "c", F.col("c").alias("r")), f"order{ORDER}")
    grams = now
    for m in range(ORDER - 1, 0, -1):
        now = now.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count("*").alias("c"), F.sum("r").alias("r"))
        now = written(now.select("lang", F.lit(m).alias("m"), "gram", "c", "r"), f"order{m}")
        grams = grams.unionByName(now)

    # one row for each language and order: discounts, and how often an n-gram must occur to stay
    stats = written(grams.groupBy("lang", "m").agg(F.sum("r").alias("all"), *[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]), "orders")
    bar = F.lit(float(least))
    if log2_size is not None:
        n_langs = stats.select(F.count_distinct("lang").alias("c")).first()["c"]
        bar = F.greatest(bar, F.col("all") * n_langs / F.lit(float(1 << log2_size)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usual = {1: 0.5, 2: 1.0, 3: 1.5}
    discounts = [F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")))).otherwise(usual[k]).alias(f"d{k}") for k in (1, 2, 3)]
    stats = stats.select("lang", "m", bar.alias("least"), *discounts)

    left = F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = grams.join(stats, ["lang", "m"]).select("lang", "m", "gram", F.shiftright("gram", 8).alias("ctx"), "c", left.alias("left"), ((F.col("r") >= F.col("least")) | (F.col("m") == 1)).alias("stays"))
    contexts = grams.groupBy("lang", "m", "ctx").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("stays"), F.col("left")).otherwise(0.0)).alias("kept"))
    contexts = written(contexts.select("lang", "m", "ctx", "total", F.greatest(F.lit(1e-9), 1 - F.col("kept") / F.col("total")).alias("gamma")), "contexts")
    # an n-gram that doesn't stay has what its context hands down
    own = F.when(F.col("stays"), F.col("left") / F.col("total")).otherwise(0.0)
    owned = written(grams.join(contexts, ["lang", "m", "ctx"]).select("lang", "m", "gram", own.alias("own"), "gamma", "stays"), "owned")

    base = owned.filter("m = 1").select("lang").distinct()
    orders = [base.select("lang", F.lit(0).alias("m"), F.lit(0).cast("long").alias("gram"), F.lit(1 / 256).alias("p"), F.lit(True).alias("stays"))]
    for m in range(1, ORDER + 1):
        below = orders[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        mine = owned.filter(F.col("m") == m).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1)))
        probs = mine.join(below, ["lang", "suffix"]).select("lang", "m", "gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"), "stays")
        orders.append(written(probs, f"kn{m}"))
    return orders, contexts


def model_table(counts: DataFrame, log2_size: int | None = None, least: int = LEAST) -> DataFrame:
    """(lang, m, gram, logp, bow) of all n-grams and contexts in the model, orders 0 to ORDER; logarithms to base 2, logp NaN for a mere context."""
    orders, contexts = smoothed(counts, log2_size, least)
    out = orders[0]
    for probs in orders[1:]:
        out = out.unionByName(probs)
    # the back-off weight of a context stands beside its own probability, if it has one
    weights = contexts.filter("gamma < 1").select("lang", (F.col("m") - 1).alias("m"), F.col("ctx").alias("gram"), "gamma")
    out = out.filter("stays").join(weights, ["lang", "m", "gram"], "full")
    return out.select("lang", "m", "gram", F.coalesce(F.log2("p"), F.lit(float("nan"))).cast("float").alias("logp"), F.log2(F.coalesce("gamma", F.lit(1.0))).cast("float").alias("bow"))


def collected(table_: DataFrame) -> Model:
    """The model of a small table on the driver, which has probabilities of unseen n-grams too; the operator reads shards."""
    langs = {r["lang"]: i for i, r in enumerate(table_.select("lang").distinct().orderBy("lang").collect())}
    number = table_.sparkSession.createDataFrame(list(langs.items()), "l string, number long")
    packed = F.shiftleft("number", 43).bitwiseOR(F.shiftleft(F.col("m").cast("long"), 40)).bitwiseOR(F.col("gram"))
    rows = table_.join(F.broadcast(number), F.col("lang") == F.col("l")).select(packed.alias("packed"), "logp", "bow").toArrow()
    hashes = mix(rows["packed"].to_numpy().astype(U64))
    order = np.argsort(hashes)
    return Model(langs, hashes[order], rows["logp"].to_numpy()[order], rows["bow"].to_numpy()[order])


class Sorted:
    """Sorted hashes, with a directory by their bits after the first `skip`, which all share."""

    hashes: np.ndarray
    skip: int = 0

    def directory(self) -> tuple[int, np.ndarray]:
        if not hasattr(self, "_dir"):
            bits = max(1, len(self.hashes).bit_length())
            ends = np.arange(1 << bits, dtype=U64) << U64(64 - bits - self.skip)
            if self.skip and len(self.hashes):
                ends |= self.hashes[0] >> U64(64 - self.skip) << U64(64 - self.skip)
            starts = np.searchsorted(self.hashes, ends)
            self._dir = bits, starts.astype(np.int32)
            self._padded = np.append(self.hashes, U64(0xFFFFFFFFFFFFFFFF))
        return self._dir

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in the arrays, or -1."""
        bits, starts = self.directory()
        at = starts[(hashes << U64(self.skip) >> U64(64 - bits)).astype(np.int64)]
        here = self._padded[at]
        found = np.where(here == hashes, at, -1)
        rest = np.flatnonzero(here < hashes)
        while len(rest):
            at[rest] += 1
            here = self._padded[at[rest]]
            want = hashes[rest]
            same = here == want
            found[rest[same]] = at[rest[same]]
            rest = rest[here < want]
        return found


@dataclass
class Model(Sorted):
    """Sorted hashes of (language, order, n-gram), with log2 probability and back-off weight of each."""

    langs: dict[str, int]
    hashes: np.ndarray
    logp: np.ndarray
    bow: np.ndarray

    @staticmethod
    def hash(lang: np.ndarray, m, gram: np.ndarray) -> np.ndarray:
        return mix(lang << U64(43) | m << U64(40) | gram)

    def bits(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each n-gram's last byte after the others."""
        out, rest = np.zeros(len(gram), np.float32), np.arange(len(gram))
        for m in range(ORDER, 0, -1):
            if not len(rest):
                return out
            now = gram[rest] & U64((1 << 8 * m) - 1)
            at = self.find(Model.hash(lang[rest], U64(m), now))
            hit = (at >= 0) & ~np.isnan(self.logp[at])
            out[rest[hit]] -= self.logp[at[hit]]
            rest, now = rest[~hit], now[~hit] >> U64(8)
            at = self.find(Model.hash(lang[rest], U64(m - 1), now))
            known = at >= 0
            out[rest[known]] -= self.bow[at[known]]
        out[rest] += 8
        return out


def lang_key(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "").encode(), digest_size=8).digest(), "little")


def gram_hash(key: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Hash of a language's key and an n-gram of the highest order."""
    return mix(gram * U64(0x9E3779B97F4A7C15) ^ key)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        keys = np.array([lang_key(k) for k in langs.dictionary.to_pylist()], U64)
        hashes = gram_hash(keys[langs.indices.to_numpy()], batch.column(1).to_numpy().astype(U64))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(2)], ["hash", "bits"])


@dataclass
class Shard(Sorted):
    hashes: np.ndarray
    values: np.ndarray
    skip: int


#: Shards that this process holds, by file.
_held: dict[str, Shard] = {}


@dataclass
class Shards:
    """Bits of each counted n-gram, in sorted files of the shared folder by the first `skip` bits of the hash."""

    files: dict[int, list[str]]
    skip: int
    fits: bool

    def shard(self, number: int) -> Shard | None:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        names = self.files.get(number)
        if not names:
            return None
        if names[0] not in _held:
            if not self.fits or not any(n[0] in _held for n in self.files.values()):
                _held.clear()
            parts = []
            for name in names:
                system, path = FileSystem.from_uri(name)
                parts.append(pq.ParquetFile(path, filesystem=system).read(["hash", "bits"]))
            rows = pa.concat_tables(parts)
            hashes, values = rows["hash"].to_numpy().view(U64), rows["bits"].to_numpy()
            if len(names) > 1:
                order = np.argsort(hashes)
                hashes, values = hashes[order], values[order]
            _held[names[0]] = Shard(hashes, values, self.skip)
        return _held[names[0]]

    def bits(self, hashes: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each n-gram's last byte after the others."""
        out = np.empty(len(hashes), np.float32)
        owner = (hashes >> U64(64 - self.skip)).astype(np.uint16)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=1 << self.skip))
        for number in range(1 << self.skip):
            mine = order[ends[number - 1] if number else 0 : ends[number]]
            if len(mine):
                shard = self.shard(number)
                at = shard.find(hashes[mine]) if shard else np.full(1, -1)
                if (at < 0).any():
                    raise LookupError("an n-gram of the texts was not counted")
                out[mine] = shard.values[at]
        return out

    def sums(self, key: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits of each text, whose language has the key."""
        bits = self.bits(gram_hash(np.repeat(key, sizes), grams))
        return np.diff(np.concatenate(([0.0], np.cumsum(bits, dtype=np.float64)))[np.concatenate(([0], np.cumsum(sizes)))])


def sharded(grams: DataFrame, rows: int | None = None, cache: int | None = None) -> Shards:
    """The table (lang, gram, p) of the highest order as shards of about `rows` rows."""
    n = grams.count()
    skip = min(16, max(1, (n // (rows or SHARD_ROWS)).bit_length()))
    hashed = grams.select("lang", "gram", (-F.log2("p")).cast("float").alias("bits")).mapInArrow(_hashed, "hash long, bits float")
    dealt = hashed.withColumn("shard", F.shiftrightunsigned("hash", 64 - skip).cast("int")).repartition("shard").sortWithinPartitions("shard", "hash")
    files: dict[int, list[str]] = {}
    for name in written(dealt, "model", by="shard").inputFiles():
        files.setdefault(int(re.search(r"/shard=(\d+)/", name)[1]), []).append(name)
    # 12 bytes a row, 8 for the padded copy, 8 at most for the directory
    return Shards(files, skip, 28 * n <= (CACHE_BYTES if cache is None else cache))


def base_metrics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    words = Words(texts)
    edges = words.text_start

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])

    out = {"q_words": words.count, "q_word_chars": per_text(NOT_SPACE[words.data] & ((words.data & 0xC0) != 0x80)), "q_symbols": per_text(SYMBOL[words.data])}
    repeated = np.zeros(len(words) + 1, np.int64)
    found = Windows(words.hashes()).every(5)
    if len(found):
        owner = words.text_of()[: len(found)]
        inside = np.arange(len(found)) + 5 <= words.first[1:][owner]
        keys = mix(found ^ (owner.astype(U64) * U64(0xA0761D6478BD642F)))[inside]
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            starts = np.flatnonzero(inside)[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
            np.add.at(repeated, starts, 1)
            np.add.at(repeated, starts + 5, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeated[:-1]) > 0)))
    out["q_repeat_words"] = np.diff(covered[words.first])
    dup = []
    for t in texts:
        lines = (t or b"").split(b"\n")
        n, seen = 0, set()
        if len(set(lines)) < len(lines):
            for line in lines:
                if line in seen:
                    n += bool(line.split())
                else:
                    seen.add(line)
        dup.append(n)
    out["q_dup_lines"] = np.array(dup, np.int64)
    return out


#: Columns that score() and judge() make, and those they read by; a caller's columns of these names go.
MADE = {"q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_bytes", "q_log_ppl", "q_base_failed", "q_lang", "q_text", "q_low", "q_high", "q_kept"}
OWN = ["q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_bytes"]


def _score(model: Shards, names: list[str], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a model that doesn't fit is read anew for each piece of text
        limit = 1 << 19 if model.fits else 1 << 23
        for batch in batches:
            field = batch.schema.get_field_index
            texts, langs = utf8(batch.column(field("q_text"))), batch.column(field("q_lang")).to_pylist()
            for a, b in pieces(texts, limit):
                parts = [base_metrics(texts[a + i : a + j]) for i, j in pieces(texts[a:b])]
                made = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                filled = [t or b"" for t in texts[a:b]]
                total = np.zeros(b - a)
                for i, j in pieces(filled, limit):
                    grams, sizes = ngrams(filled[i:j])
                    own = np.array([lang_key(k) for k in langs[a + i : a + j]], U64)
                    total[i:j] = model.sums(own, grams, sizes)
                made["q_bytes"] = np.fromiter(map(len, filled), np.int64, b - a)
                # rounded, as the model's last bits depend on the order of sums
                log_ppl = pa.array(np.round(total / np.maximum(made["q_bytes"] - made["q_symbols"], 1), 5), pa.float64(), mask=made["q_bytes"] == 0)
                own = [pa.array(made[k], pa.int64()) for k in OWN] + [log_ppl]
                yield pa.RecordBatch.from_arrays([batch.column(field(n)).slice(a, b - a) for n in names] + own, schema=arrow)
        _held.clear()  # the worker outlives the task
        tidy()

    return run


def score(docs: DataFrame, *, text: str = "text", lang: str = "lang", carry: list[str] | None = None, log2_size: int | None = None, shard_rows: int | None = None, cache_bytes: int | None = None) -> DataFrame:
    """`docs` (or its columns `carry`) with base metrics, q_log_ppl (bits a byte that is no symbol) and q_base_failed, as a written table."""
    counts = written(count(docs, text, lang), "ngrams")
    model = sharded(smoothed(counts, log2_size)[0][ORDER], shard_rows, cache_bytes)
    names = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("q_lang", T.StringType())] + [T.StructField(c, T.LongType()) for c in OWN] + [T.StructField("q_log_ppl", T.DoubleType())])
    rows = docs.select(*names, F.col(lang).cast("string").alias("q_lang"), F.col(text).cast("string").alias("q_text"))
    scored = written(rows.mapInArrow(_score(model, [*names, "q_lang"], schema), schema), "scored")
    return scored.withColumn("q_base_failed", (F.col("q_words") < 10) | (100 * F.col("q_repeat_words") > 20 * F.col("q_words")))


def judge(scored: DataFrame, *, reach: float = REACH, short: float = SHORT) -> DataFrame:
    """With q_low, q_high (the band for the document's language and size) and q_kept."""
    lang = F.coalesce("q_lang", F.lit("")).alias("band_lang")
    # exact on a grid, so that the bands don't depend on the order of rows; at most GRID * MOST rows a language
    steps = F.least(F.floor(F.col("q_log_ppl") * GRID), F.lit(GRID * MOST)).alias("step")
    counted = scored.filter(~F.col("q_base_failed")).groupBy(lang, steps).agg(F.count("*").alias("n"))
    running = Window.partitionBy("band_lang").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy("band_lang")))
    quartiles = [(F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("step"))) / F.lit(float(GRID))).alias(name) for k, name in ((1, "q1"), (3, "q3"))]
    bands = written(upto.groupBy("band_lang").agg(*quartiles), "bands")
    if bands.count() <= FEW_LANGS:  # one row a language: all documents of one stay where they are
        bands = F.broadcast(bands)
    joined = scored.join(bands, F.coalesce("q_lang", F.lit("")) == F.col("band_lang"), "left")
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(float(short)) / F.sqrt(F.greatest("q_bytes", F.lit(1))))
    inside = F.col("q_log_ppl").between(F.col("q1") - spread, F.col("q3") + spread)
    return joined.select(*scored.columns, (F.col("q1") - spread).alias("q_low"), (F.col("q3") + spread).alias("q_high"), (~F.col("q_base_failed") & F.coalesce(inside, F.lit(False))).alias("q_kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(score(table(spark, sf_dir, "documents"), carry=["doc_id"]))
    return judged.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.pow(F.lit(2.0), F.col("q_log_ppl")).alias("perplexity"))
