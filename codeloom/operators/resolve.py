"""Import resolution: from raw import targets to edges between files.

An import names one module; the module has a few candidate paths, in order. All
candidates are joined with the files on the path, and the first hit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed values.
CONFIDENCE, LABEL, EVIDENCE = 1.0, "high", "rust module path resolved to local file"
OUTSIDE, TOPS = ("", "std", "core", "alloc"), ("main", "lib", "mod", "")


def module_name(target: Column) -> Column:
    """First segment of an import path after one crate::, self:: or super::, cut to name characters; null if it is none or outside."""
    bare = F.regexp_replace(text.trim(target), "^(crate::|self::|super::)", "")
    first = F.regexp_replace(F.get(F.split(bare, "::", -1), F.lit(0)), r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+\z", "")
    return F.when(~first.isin(*OUTSIDE), first)


def candidates(path: Column, module: Column) -> Column:
    """Paths where the module may be, in order."""
    folder, own = text.parent(path), text.stem(path)
    beside = [text.join_path(folder, module, ".rs"), text.join_path(folder, module, "/mod.rs"), F.concat(F.lit("src/"), module, F.lit(".rs")), F.concat(F.lit("src/"), module, F.lit("/mod.rs"))]
    below = [text.join_path(folder, own, "/", module, ".rs"), text.join_path(folder, own, "/", module, "/mod.rs")]
    return F.when(own.isin(*TOPS), F.array(*beside)).otherwise(F.array(*below, *beside))


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (file_id, relative_path, language), imports (file_id, raw_target, line) -> the imports_file table.

    Of several imports between two files the first by line counts (then by
    target). A file can import itself. Files are never broadcast: they are as many
    as the tree has, and wider than the sizes that the optimizer guesses.
    """
    active = files.select("file_id", text.path_key(F.col("relative_path")).alias("relative_path"), "language")
    rows = imports.join(active.filter("language = 'rust'").hint("merge"), "file_id").select("file_id", "relative_path", "raw_target", "line", module_name(F.col("raw_target")).alias("module")).filter("module IS NOT NULL")
    tried = rows.select("file_id", "raw_target", "line", F.posexplode(candidates(F.col("relative_path"), F.col("module"))).alias("priority", "candidate"))
    targets = active.select(F.col("file_id").alias("to_file_id"), F.col("relative_path").alias("candidate"))
    hit = tried.join(targets.hint("merge"), "candidate").groupBy("file_id", "raw_target", "line").agg(F.min_by("to_file_id", "priority").alias("to_file_id"))
    first = hit.groupBy(F.col("file_id").alias("from_file_id"), "to_file_id").agg(F.min_by("raw_target", F.struct("line", "raw_target")).alias("raw_target"))
    return first.select("from_file_id", "to_file_id", "raw_target", F.lit(CONFIDENCE).alias("confidence_score"), F.lit(LABEL).alias("confidence_label"), F.lit(EVIDENCE).alias("evidence"))
