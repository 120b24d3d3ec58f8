"""Incremental plan: a scan against stored fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Context
from ..functions import ids, text

KINDS = ("added", "modified", "unchanged", "deleted", "skipped", "reindex_needed")
#: Kinds whose files are parsed.
PARSED = ("added", "modified", "reindex_needed")


def _stored(column: str) -> Column:
    return F.col(f"s_{column}")


def incremental_plan(files: DataFrame, skipped: DataFrame, stored: DataFrame, context: Context) -> DataFrame:
    """file_id, relative_path, kind, sha256, size_bytes, mtime_seconds, previous_sha256, current_sha256, reason, section.

    stored: the file table's rows of the scope. One full join on file_id decides
    on scanned and vanished files; skipped files are added. A tracked file that is
    skipped now is listed twice, as deleted and as skipped. Order by
    path_order(relative_path), section.
    """
    kept = stored.filter(F.col("scope_id") == context.scope_id)
    columns = ("file_id", "relative_path", "sha256", "size_bytes", "mtime_seconds", "status", "parser_version", "graph_schema_version", "chunker_version")
    old = kept.select(*[F.col(c).alias(f"s_{c}") for c in columns])
    new = files.select("file_id", "relative_path", "sha256", "size_bytes", "mtime_seconds")
    both = new.join(old, F.col("file_id") == _stored("file_id"), "full")
    seen, known = F.col("file_id").isNotNull(), _stored("file_id").isNotNull()
    gone = known & (_stored("status") == "deleted")
    outdated = (_stored("parser_version") != context.parser_version) | (_stored("graph_schema_version") != context.schema_version) | (_stored("chunker_version") != context.chunker_version)
    kind = F.when(seen & ~known, "added").when(seen & gone, "added").when(seen & (_stored("sha256") != F.col("sha256")), "modified").when(seen & outdated, "reindex_needed").when(seen, "unchanged").when(~gone, "deleted")
    reason = F.when(seen & gone, "previously soft-deleted").when(F.col("kind") == "reindex_needed", "version mismatch")
    changes = both.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        F.coalesce("file_id", "s_file_id").alias("file_id"),
        F.coalesce("relative_path", "s_relative_path").alias("relative_path"),
        "kind",
        *[F.when(seen, F.col(c)).otherwise(_stored(c)).alias(c) for c in ("sha256", "size_bytes", "mtime_seconds")],
        _stored("sha256").alias("previous_sha256"),
        F.col("sha256").alias("current_sha256"),
        reason.alias("reason"),
        F.when(F.col("kind") == "deleted", 1).otherwise(0).alias("section"),
    )
    left_out = skipped.select(ids.skipped_file_id(F.col("relative_path")).alias("file_id"), "relative_path", F.lit("skipped").alias("kind"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("mtime_seconds"), F.lit(None).cast("string").alias("previous_sha256"), F.lit(None).cast("string").alias("current_sha256"), "reason", F.lit(2).alias("section"))
    return changes.unionByName(left_out)


def changes_of_kind(plan: DataFrame, *kinds: str) -> DataFrame:
    return plan.filter(F.col("kind").isin(*kinds))


def changed_files(plan: DataFrame) -> DataFrame:
    """All but unchanged files, in order."""
    return plan.filter("kind != 'unchanged'").orderBy(text.path_order(F.col("relative_path")), "section")


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row: files by kind; scanned_files and warnings are 0 until an index run knows them."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    return plan.agg(*counts).select(F.lit(0).cast("long").alias("scanned_files"), *KINDS, F.lit(0).cast("long").alias("warnings"))


def repo_status(plan: DataFrame, stored: DataFrame, context: Context) -> DataFrame:
    """One row: tracked (stored and not deleted), scanned, and files by kind."""
    scanned = F.count_if(F.col("section") == 0).alias("scan_files")
    tracked = stored.filter((F.col("scope_id") == context.scope_id) & (F.col("status") != "deleted")).agg(F.count("*").alias("n"))
    return plan.agg(scanned, *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]).select(tracked.scalar().alias("tracked_files"), "scan_files", "added", "modified", "deleted", "unchanged", "skipped", "reindex_needed")
