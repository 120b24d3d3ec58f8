"""Scan: from file entries to fingerprinted source files and skipped files.

Filters in fixed order: ignored names, size, binary content, language. So a large
or binary file of an unknown language is reported as skipped, a small text file
of one is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Context
from ..functions import ids, text
from ..sources.tree import read_tree

#: Languages by file extension, case-sensitive.
EXTENSIONS = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
#: Bytes at the beginning of a file in which a NUL makes it binary.
SNIFF = 1024


def language(path: Column) -> Column:
    by = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(by, lambda k, _: k == text.extension(path))), F.lit(0)), F.lit("unknown"))


def is_ignored(path: Column, names: tuple[str, ...]) -> Column:
    """Whether any component of the path, the file name too, is among the names."""
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(n) for n in names]))


def is_binary(content: Column) -> Column:
    return F.position(F.lit(b"\0"), F.substring(content, 1, SNIFF)) > 0


def classify(entries: DataFrame, config: Config) -> DataFrame:
    """Entries that are not ignored, with `language` and `reason`: null, 'oversized' or 'binary'."""
    kept = entries.filter(~is_ignored(F.col("relative_path"), config.ignored_dirs))
    reason = F.when(F.col("size_bytes") > config.max_file_size_bytes, "oversized").when(is_binary(F.col("content")), "binary")
    return kept.withColumns({"language": language(F.col("relative_path")), "reason": reason})


@dataclass
class Scan:
    """files: repo_id, file_id, path, relative_path, language, sha256, size_bytes, mtime_seconds, content. skipped: relative_path, reason."""

    context: Context
    files: DataFrame
    skipped: DataFrame


def scan_entries(entries: DataFrame, context: Context, config: Config | None = None) -> Scan:
    config = config or Config()
    found = classify(entries, config)
    files = found.filter(F.col("reason").isNull() & F.col("language").isin(*config.enabled_languages)).select(
        F.lit(context.repo_id).alias("repo_id"),
        ids.file_id(context.project_id, context.scope_id, F.col("relative_path")).alias("file_id"),
        "path",
        "relative_path",
        "language",
        F.sha2("content", 256).alias("sha256"),
        "size_bytes",
        F.coalesce("mtime_seconds", F.lit(0)).cast("long").alias("mtime_seconds"),
        "content",
    )
    return Scan(context, files, found.filter(F.col("reason").isNotNull()).select("relative_path", "reason"))


def scan_tree(spark: SparkSession, root: str, config: Config | None = None) -> Scan:
    return scan_entries(read_tree(spark, root, config), Context.of(root), config)


def source_text(content: Column) -> Column:
    """Content as text; anything but UTF-8 is an error."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.raise_error(F.lit("failed to read source file: not UTF-8")))
