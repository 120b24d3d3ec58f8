"""Operator 9 [native]: URL filter rules through a blocked Bloom filter.

A rule is a canonical URL prefix, host and path ("example.net/en/"), that fits
its host, all subdomains, and every path that starts with its own. A page's
possible keys are the suffixes of its host with the prefixes of its path that
have the length of some rule's path. A blocked Bloom filter (blocks of 512 bits,
8 bits a key, all in one block) over the rules' keys drops nearly all keys that
are no rule: keys meet their block by a broadcast join. Those that pass are joined
with the rules on the key itself, which removes false positives. The longest rule
decides.

The filter is a table of at most MAX_BLOCKS blocks of 64 bytes, whatever the
number of rules, so that it may be broadcast; with more rules it only lets more
keys through to the join. Pages meet their rule by url, so that the wide table is
not exploded; Spark splits a hot url, and rows without a url stay out of the join.

Defined results: a null url or one without "://" has an empty host and path
and the default verdict. A rule listed twice with both verdicts blocks. Repeated
rows are judged alike. Other columns are carried as they are, but for those named
like the operator's own four (`url_...`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Fixed rules of the query: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS_A_KEY, N_BITS, MAX_BLOCKS = 16, 8, 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(_part(url, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(_part(url, 2), F.lit(""))


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)([^?#]*)", group))


def _bit(key: Column, i: int) -> Column:
    """Bit i of a key in its block, from a second hash, 9 bits at a time."""
    return F.shiftright(F.xxhash64(F.lit(i // 7), key), 9 * (i % 7)).bitwiseAND(F.lit(511))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter's blocks (block, words: eight longs), those with a bit, and how many there can be."""
    n_blocks = 1
    while n_blocks * 512 < n_keys * BITS_A_KEY and n_blocks < MAX_BLOCKS:
        n_blocks *= 2
    masks = [F.bit_or(F.when(F.col("word") == w, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(8)]
    bit = F.explode(F.array(*[_bit(F.col("key"), i) for i in range(N_BITS)])).alias("bit")
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), bit)
    bits = bits.select("block", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mask"))
    return bits.groupBy("block").agg(*masks).select("block", F.array(*[f"w{w}" for w in range(8)]).alias("words")), n_blocks


def _possible(key: Column, words: Column) -> Column:
    """Whether all bits of the key are set in its block."""
    found = F.lit(True)
    for i in range(N_BITS):
        bit = _bit(key, i)
        found = found & (F.call_function("getbit", F.get(words, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with url_host, url_path, url_rule (or null) and url_verdict, by `rules` (rule, verdict)."""
    listed = rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    listed = listed.select(F.col("rule").alias("key"), "verdict", F.length("rule").alias("n"), F.length(F.substring_index("rule", "/", 1)).alias("host_n"))
    # lengths of rules' paths, at most as many as the longest has characters; one literal
    lengths, n_keys = sorted(r["m"] for r in listed.select((F.col("n") - F.col("host_n")).alias("m")).distinct().collect()), listed.count()
    own = {"url_host", "url_path", "url_rule", "url_verdict"}
    kept = [pages[c] for c in pages.columns if c not in own]
    made = [host(pages[url]).alias("url_host"), path(pages[url]).alias("url_path")]
    unruled = pages.select(*kept, *made, F.lit(None).cast("string").alias("url_rule"), F.lit(default).alias("url_verdict"))
    if not n_keys:
        return unruled
    blocks, n_blocks = bloom(listed.select("key"), n_keys)
    urls = pages.select(F.col(url).alias("u")).filter(F.col("u").isNotNull()).distinct().select("u", host(F.col("u")).alias("h"), path(F.col("u")).alias("p"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    every = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>")
    prefixes = F.transform(F.filter(every, lambda n: n <= F.length("p")), lambda n: F.substring("p", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    tried = urls.select("u", F.explode(F.array_distinct(keys)).alias("key")).withColumn("block", _block(F.col("key"), n_blocks))
    passed = tried.join(F.broadcast(blocks), "block").filter(_possible(F.col("key"), F.col("words"))).select("u", "key")
    best = passed.join(listed, "key").groupBy("u").agg(F.max_by(F.struct("key", "verdict"), F.struct("n", "host_n")).alias("best"))
    judged = pages.filter(F.col(url).isNotNull()).join(best, pages[url] == best["u"], "left")
    judged = judged.select(*kept, *made, F.col("best.key").alias("url_rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("url_verdict"))
    return judged.unionByName(unruled.filter(pages[url].isNull()))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP9_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM p),
f AS (
  SELECT q.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
  GROUP BY q.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN f USING (n)
"""
