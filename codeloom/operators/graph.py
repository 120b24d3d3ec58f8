"""Graph queries: dependencies, neighbours, impact, explanations, export edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..plans.shared import kept

#: Fixed values of evidence.
EDGE_SOURCE = "heuristic-parser"


def dependencies(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the paths of both ends; both must be among the files, which are never broadcast."""
    start = files.select(F.col("file_id").alias("from_file_id"), F.col("relative_path").alias("from_relative_path"))
    end = files.select(F.col("file_id").alias("to_file_id"), F.col("relative_path").alias("to_relative_path"))
    return edges.join(start.hint("merge"), "from_file_id").join(end.hint("merge"), "to_file_id").select("from_file_id", "to_file_id", "from_relative_path", "to_relative_path", "raw_target", "confidence_score", "confidence_label", "evidence")


def neighbors(deps: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Outgoing and incoming dependencies of a file."""
    order = ["from_relative_path", "to_relative_path"]
    return deps.filter(F.col("from_relative_path") == path).orderBy(*order), deps.filter(F.col("to_relative_path") == path).orderBy(*order)


def impact(deps: DataFrame, path: str) -> DataFrame:
    """Files that depend on the file, directly or not: file_id, relative_path, depth, via_relative_path.

    Level by level, each written once: one join of the frontier with the edges, the best way to
    each new file, and an anti-join with what was found. `key` is the way from
    the first step on; at one depth such arrays compare as a queue would deliver,
    so the least is the way a breadth-first search takes. The start itself is
    reported if a cycle leads back to it.
    """
    edges = kept(deps.select(F.col("from_file_id").alias("id"), F.col("from_relative_path").alias("step"), F.col("to_relative_path").alias("into")), "ways")
    frontier = deps.sparkSession.createDataFrame([(path,)], "at string").withColumn("key", F.array().cast("array<string>"))
    found: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        reached = edges.join(frontier, F.col("into") == F.col("at")).groupBy("id", "step").agg(F.min(F.struct("key", "at")).alias("best"))
        if found is not None:
            reached = reached.join(found.select("id"), "id", "left_anti")
        level = kept(reached.select("id", "step", F.lit(depth).alias("depth"), F.col("best.at").alias("via"), F.array_append("best.key", F.col("step")).alias("key")), "level")
        if level.isEmpty():
            break
        frontier = level.select(F.col("step").alias("at"), "key")
        found = level if found is None else found.unionByName(level)
    if found is None:
        found = level
    return found.select(F.col("id").alias("file_id"), F.col("step").alias("relative_path"), "depth", F.col("via").alias("via_relative_path")).orderBy("depth", text.path_order(F.col("relative_path")))


def _edge(start: Column, end: Column, kind: str, snake: str, detail: Column) -> list[Column]:
    confidence = F.struct(F.lit(1.0).cast("float").alias("score"), F.lit("high").alias("label"))
    return [ids.edge_id(start, end, snake, detail).alias("edge_id"), start.alias("from_id"), end.alias("to_id"), F.lit(kind).alias("kind"), confidence.alias("confidence"), F.struct(F.lit(EDGE_SOURCE).alias("source"), detail.alias("detail")).alias("evidence")]


def export_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of the exported graph, with `place`, which orders them: by file, symbols before imports, a symbol's two edges together."""
    place = files.select("file_id", text.path_order(F.col("relative_path")).alias("path_order"))
    s = symbols.join(place, "file_id")
    file, symbol, name = F.col("file_id"), F.col("symbol_id"), F.col("name")

    def at(section: int, side: int) -> Column:
        return F.struct(F.col("path_order"), F.lit(section).alias("section"), F.col("position"), F.lit(side).alias("side")).alias("place")

    defines = s.select(*_edge(file, symbol, "Defines", "defines", F.concat(F.lit("defines:"), name)), at(0, 0))
    belongs = s.select(*_edge(symbol, file, "BelongsTo", "belongs_to", F.concat(F.lit("belongs_to:"), name)), at(0, 1))
    target = F.col("raw_target")
    used = imports.join(place, "file_id").select(*_edge(file, ids.import_target_id(target), "Imports", "imports", F.concat(F.lit("imports:"), target)), at(1, 0))
    return defines.unionByName(belongs).unionByName(used)


def language_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files")).orderBy("language")


def directory_summary(files: DataFrame) -> DataFrame:
    folder = text.parent(F.col("relative_path"))
    return files.groupBy(F.when(folder == "", ".").otherwise(folder).alias("directory")).agg(F.count("*").alias("files")).orderBy("directory")


def imports_summary(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'Imports'").groupBy(F.col("evidence.detail").alias("detail")).agg(F.count("*").alias("imports")).orderBy("detail")
