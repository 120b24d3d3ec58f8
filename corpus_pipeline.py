"""The corpus pipeline: five stages over `documents`, each a table for the next.

Part of the subpackage codeloom.llm, though it lies at the top. Each stage takes
(spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of `documents` (the last: token files read back). Columns of `docs` that
are named like an operator's own survive, as rows travel in one struct.

Defined results: an empty table stays empty. Null and empty texts fail the base
rules and go in the first stage. Of a near-duplicate group one row stays, also
where rows are repeated. A document that the mix takes twice is two rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, mixing, near, packing, quality
from codeloom.llm.shared import forget, made, own_dir, remove, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage that ran last; they go when the next begins on its written result.
_last: list[str] = []


def _tidied(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _last, docs)
        first = len(made())
        result = stage(spark, docs, sf_dir)
        _last[:] = made(first)
        return result

    return begun


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one struct, and the columns that a stage reads."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


@_tidied
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(quality.score(_rows(docs, "text", "lang"), carry=["row"]))
    return judged.filter("q_kept").select("row.*")


@_tidied
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (of five-word shingles): that of the smallest doc_id, once if its row is repeated."""
    found = near.near_duplicates(docs)
    # ids and nodes without a null, so that both joins and groups go by the same keys
    row_id, row_node = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col("near_node"), F.lit(b""))
    stay = found.filter("kept").select(row_id.alias("row_id"), row_node.alias("row_node"), F.coalesce("near_group", row_id).alias("group"))
    stay = stay.groupBy("group", "row_id").agg(F.min("row_node").alias("row_node")).select("row_id", "row_node").distinct()
    noded = near.with_nodes(_rows(docs, "doc_id", "text")).select("row", row_id.alias("row_id"), row_node.alias("row_node"))
    return noded.join(stay, ["row_id", "row_node"], "left_semi").groupBy("row_id", "row_node").agg(F.first("row").alias("row")).select("row.*")


@_tidied
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    scanned = decontaminate.decontaminate(_rows(docs, "text"), table(spark, sf_dir, "benchmark"))
    return scanned.filter(~F.col("hit_contaminated")).select("row.*")


@_tidied
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(_rows(docs, "text", "source", "doc_id"))
    return mixed.filter("mix_times > 0").select("row", F.explode(F.sequence(F.lit(1), "mix_times"))).select("row.*")


@_tidied
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return packing.read_ids(packing.write_ids(docs, packing.tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: The first stage's language model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written in the shared folder and read again, and goes when the next is there."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        folder = own_dir(spark, "stage")
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/table")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/table")
        if before:
            remove(spark, before)
        before = folder
    return docs
