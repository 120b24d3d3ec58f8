"""Operator 5 [native]: mixing sources to target weights.

Hash-threshold histograms: every document has a fixed hash of DIGITS * BITS
bits. Tokens are summed by source and the hash's first BITS bits; the running
sums tell where each source's budget ends, which is inside one bucket of 4096;
only that bucket is summed again by the next BITS bits, and so on. What lies
under the threshold is taken. Nothing is sorted; each histogram has at most
4096 rows a source, however many documents there are, and the same budget or a
larger one always takes the same documents or more (nested).

A source whose target exceeds its size is taken whole, and the rest of the
target again under the threshold: no document is taken more than twice.

Defined results: a null text has size 0; null is a source of its own, the last
one; rows that share doc_id and text share a hash, and are taken together. With
no words at all every target is 0. Other columns are carried as they are; the
operator's own columns start with `mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Weights of the sources in order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Hexadecimal digits in one level of the hash, and levels.
DIGITS, LEVELS = 3, 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level(digest: Column, k: int) -> Column:
    """Bits of level k of the hash, 0 to 4095."""
    return F.conv(F.substring(digest, 1 + k * DIGITS, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, mix_source_size) -> with mix_target: shares by weight, none above `most` times its size.

    Water filling in closed form: sources are full in the order of size by
    weight, so running sums in that order give the common rate of the rest.
    One row a source; the sums of rows before a source need them in one place, so
    one task holds as many rows as there are sources, and nothing of documents.
    """
    by_source, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights)))))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = (
        ranked.withColumn("ratio", F.col("mix_source_size") / F.col("weight"))
        .withColumn("full_size", F.coalesce(F.sum("mix_source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("mix_source_size").over(every))
        .withColumn("rate", (F.lit(float(share)) * F.col("total") - F.lit(float(most)) * F.col("full_size")) / F.col("left_weight"))
        .withColumn("is_full", F.col("rate") * F.col("weight") > F.lit(float(most)) * F.col("mix_source_size"))
    )
    # the first source, in that order, that is not full sets the rate of all after it
    return run.withColumn("open_rate", F.first(F.when(~F.col("is_full"), F.col("rate")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))).select(
        "source", "mix_source_size", F.when(F.col("open_rate").isNull(), F.lit(float(most)) * F.col("mix_source_size")).otherwise(F.col("open_rate") * F.col("weight")).alias("mix_target")
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, t0 .. tn): take a document if the digits of its hash are below, in order."""
    # what the threshold must take: the whole target, or what exceeds the source's size
    at = goals.select("source", F.when(F.col("mix_target") >= F.col("mix_source_size"), F.col("mix_target") - F.col("mix_source_size")).otherwise(F.col("mix_target")).alias("goal"))
    order, spark = Window.partitionBy("source").orderBy("bucket"), sized.sparkSession
    found: list[str] = []
    for k in range(LEVELS):
        rows = sized
        if k:
            # only the boundary bucket is summed again
            rows = sized.join(at.drop("goal"), (sized["source"].eqNullSafe(at["source"])) & F.expr(" AND ".join(f"{x} = b{i}" for i, x in enumerate(found)))).select(sized["source"], sized["size"], sized["digest"])
        histogram = rows.groupBy("source", level(F.col("digest"), k).alias("bucket")).agg(F.sum("size").alias("n"))
        running = histogram.withColumn("upto", F.sum("n").over(order)).alias("h")
        goal = at.select(F.col("source").alias("s"), F.col("goal").alias("g"), *[f"b{i}" for i in range(k)])
        cut = (
            goal.join(running, F.col("s").eqNullSafe(F.col("source")) & (F.col("upto") <= F.col("g")), "left")
            .groupBy("s", "g", *[f"b{i}" for i in range(k)])
            .agg(F.max("bucket").alias("last"), F.coalesce(F.max("upto"), F.lit(0)).alias("under"))
        )
        # the boundary is the first bucket with tokens that no longer fits
        nxt = cut.join(running.filter(F.col("n") > 0), F.col("s").eqNullSafe(F.col("source")) & ((F.col("bucket") > F.col("last")) | F.col("last").isNull()), "left").groupBy("s", "g", "under", *[f"b{i}" for i in range(k)]).agg(F.coalesce(F.min("bucket"), F.lit(16**DIGITS)).alias(f"b{k}"), F.min_by("n", "bucket").alias("n"))
        at = nxt.select(F.col("s").alias("source"), (F.col("g") - F.col("under")).alias("goal"), *[f"b{i}" for i in range(k + 1)], "n")
        if k == LEVELS - 1:  # documents of one hash: all or none, whichever is nearer
            at = at.withColumn(f"b{k}", F.when(2 * F.col("goal") >= F.col("n"), F.col(f"b{k}") + 1).otherwise(F.col(f"b{k}")))
        at = written(at.drop("n"), f"mix{k}")
        found.append(level_sql(k))
    return at.drop("goal")


def level_sql(k: int) -> str:
    return f"CAST(conv(substring(digest, {1 + k * DIGITS}, {DIGITS}), 16, 10) AS BIGINT)"


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target, mix_times (how often the mix takes it) and mix_taken (words it takes)."""
    narrow = docs.select(F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), digest(F.col(key), F.col(text)).alias("digest"))
    sized = written(narrow, "mix-sizes")
    goals = written(targets(sized.groupBy("source").agg(F.sum("size").alias("mix_source_size")), weights, share, most), "mix-targets")
    cut = goals.join(thresholds(sized, goals).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").select(F.col("source").alias("mix_s"), "mix_source_size", "mix_target", *[f"b{i}" for i in range(LEVELS)])
    own = {"mix_size", "mix_source_size", "mix_target", "mix_times", "mix_taken"}
    kept = [c for c in docs.columns if c not in own]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source).cast("string").alias("mix_key"), n_words(F.col(text)).alias("mix_size"), digest(F.col(key), F.col(text)).alias("digest"))
    under = F.lit(False)
    for k in reversed(range(LEVELS)):
        under = (level(F.col("digest"), k) < F.col(f"b{k}")) | ((level(F.col("digest"), k) == F.col(f"b{k}")) & under)
    times = F.when(F.col("mix_target") >= F.col("mix_source_size"), 1).otherwise(0) + F.when(under, 1).otherwise(0)
    joined = rows.join(cut, F.col("mix_key").eqNullSafe(F.col("mix_s")), "left")
    joined = joined.withColumn("mix_times", F.least(times, F.lit(int(most))))
    return joined.select("row.*", "mix_size", "mix_source_size", "mix_target", "mix_times", (F.col("mix_size") * F.col("mix_times")).alias("mix_taken"))


def digest(key: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


#: The same by sorting: running sums over the hash order, the boundary document to the nearer side.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT source, z, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (
  SELECT source, z, weight, z / weight AS ratio,
         coalesce(sum(z) OVER (ORDER BY z / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
         sum(weight) OVER (ORDER BY z / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
         sum(z) OVER () AS total
  FROM w),
q AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * full_size::DOUBLE) / left_weight AS rate FROM r),
o AS (
  SELECT source, z, weight,
         first_value(CASE WHEN rate * weight > 2.0::DOUBLE * z::DOUBLE THEN NULL ELSE rate END IGNORE NULLS)
           OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_rate
  FROM q),
t AS (SELECT source, z, CASE WHEN open_rate IS NULL THEN 2.0::DOUBLE * z::DOUBLE ELSE open_rate * weight END AS target FROM o),
g AS (
  SELECT d.*, t.z, t.target, CASE WHEN t.target >= t.z THEN t.target - t.z ELSE t.target END AS goal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY source, h) AS own
  FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target,
       CAST(size * ((CASE WHEN target >= z THEN 1 ELSE 0 END)
         + (CASE WHEN upto <= goal OR (upto - own <= goal AND 2 * (goal - (upto - own)) >= own) THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM c
"""
