"""The graph store: versioned Parquet snapshots behind one manifest.

A change writes new folders for the tables that it touches and then replaces the
manifest by one rename, which is the commit. Readers see the version they
opened; a failed job leaves folders that no manifest names, and vacuum() removes
what the manifest doesn't name. Tables change as sets: rows of the touched keys are
dropped by an anti-join, new ones added. Tables of files and what belongs to them
lie in buckets by file, of which only those with a touched file are written again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Context
from ..operators import change, graph, parse, resolve
from ..operators.scan import Scan, source_text
from .shared import kept

Clock = Callable[[], str]
#: Buckets of files; a large store wants more of them.
BUCKETS = 8


def epoch_seconds() -> str:
    return str(int(time.time()))


class Store(Protocol):
    """What commands and queries need of a store; GraphStore is the one on Spark tables."""

    def init_schema(self, *, rebuild: bool = True) -> None: ...
    def reset(self) -> None: ...
    def table(self, name: str) -> DataFrame: ...
    def begin_index_run(self, context: Context) -> str: ...
    def complete_index_run(self, run: str, stats: dict[str, int]) -> None: ...
    def fail_index_run(self, run: str, error: str) -> None: ...
    def incremental_plan(self, scan: Scan) -> DataFrame: ...
    def apply(self, scan: Scan, plan: DataFrame, run: str) -> int: ...
    def rebuild_scope_import_edges(self, context: Context) -> int: ...
    def repo_status(self, scan: Scan) -> dict[str, int]: ...
    def changed_files(self, scan: Scan) -> DataFrame: ...
    def explain(self, scope: str, path: str) -> dict[str, DataFrame] | None: ...
    def neighbors(self, scope: str, path: str) -> tuple[DataFrame, DataFrame] | None: ...
    def impact(self, scope: str, path: str) -> DataFrame | None: ...
    def vacuum(self) -> int: ...


class SchemaMismatch(RuntimeError):
    """The store was written under another schema version."""


class GraphStore:
    """Tables of one store folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, clock: Clock = epoch_seconds, buckets: int = BUCKETS):
        """`buckets` must stay what it was when the store was made."""
        self.spark, self.path, self.clock, self.buckets = spark, path.rstrip("/"), clock, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest

    def _manifest(self) -> dict | None:
        where = self._path(f"{self.path}/manifest.json")
        if not self._files.exists(where):
            return None
        stream = self._files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, tables: dict[str, str]) -> None:
        raw = json.dumps({"schema_version": schemas.SCHEMA_VERSION, "tables": tables}, indent=2, sort_keys=True).encode()
        new = self._path(f"{self.path}/manifest.{uuid.uuid4().hex}.tmp")
        stream = self._files.create(new, True)
        stream.write(raw)
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        context.rename(new, self._path(f"{self.path}/manifest.json"), kinds)

    def stored_schema_version(self) -> str | None:
        found = self._manifest()
        return found["schema_version"] if found else None

    def exists(self) -> bool:
        return self._manifest() is not None

    def reset(self) -> None:
        self._files.delete(self._path(self.path), True)

    def init_schema(self, *, rebuild: bool = True) -> None:
        """Makes an empty store if there is none. One of another version is dropped, or, if it may not be rebuilt, reported."""
        version = self.stored_schema_version()
        if version == schemas.SCHEMA_VERSION:
            return
        if version is not None:
            if not rebuild:
                raise SchemaMismatch(f"store has schema {version}, not {schemas.SCHEMA_VERSION}: index again")
            self.reset()
        empty = {n: self.spark.createDataFrame([], schema).coalesce(1) for n, schema in schemas.TABLES.items() if n not in schemas.BY_FILE}
        empty["schema_meta"] = self.spark.createDataFrame([("schema_version", schemas.SCHEMA_VERSION)], schemas.TABLES["schema_meta"])
        self._write(empty, fresh=True)

    # tables

    def table(self, name: str) -> DataFrame:
        """A table, or a relation as (start, end) view; empty if nothing was written."""
        if name in schemas.RELATIONS:
            source, start, end = schemas.RELATIONS[name]
            return self.table(source).filter(F.col(start).isNotNull()).select(start, end)
        return self._read(name, self._folders(name).values())

    def _folders(self, name: str) -> dict[str, str]:
        """Folder of each bucket that was written, or of the whole table."""
        return (self._manifest() or {"tables": {}})["tables"].get(name, {})

    def _read(self, name: str, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*paths)

    def tables(self) -> list[str]:
        return sorted([*schemas.TABLES, *schemas.RELATIONS])

    def _write(self, new: dict[str, DataFrame], fresh: bool = False, touched: list[int] | None = None) -> None:
        """Writes tables, then commits them together. With `touched`, tables by file are given and replaced for those buckets only."""
        tables = dict.fromkeys(schemas.BY_FILE, {}) if fresh else dict((self._manifest() or {"tables": {}})["tables"])
        for name, rows in new.items():
            folder = f"data/{name}-{uuid.uuid4().hex}"
            fields = [F.col(c).cast(kind).alias(c) for c, kind in schemas.columns(name).items()]
            if name not in schemas.BY_FILE:
                rows.select(*fields).write.parquet(f"{self.path}/{folder}")
                tables[name] = {"": folder}
                continue
            # one file a bucket
            dealt = rows.select(*fields, self._bucket().alias("bucket")).repartition(self.buckets, "bucket")
            dealt.write.parquet(f"{self.path}/{folder}", partitionBy="bucket")
            there = {k: f"{folder}/bucket={k}" for k in range(self.buckets) if self._files.exists(self._path(f"{self.path}/{folder}/bucket={k}"))}
            old = {} if touched is None else {k: f for k, f in tables.get(name, {}).items() if int(k) not in touched}
            tables[name] = old | {str(k): f for k, f in there.items()}
        self._commit(tables)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int")

    def _touched(self, name: str, buckets: list[int]) -> DataFrame:
        """Rows of a table by file in the buckets."""
        return self._read(name, [f for k, f in self._folders(name).items() if int(k) in buckets])

    def vacuum(self) -> int:
        """Removes folders that the manifest doesn't name, to be called when no reader has an older version open; returns how many."""
        named = {f.split("/")[1] for folders in (self._manifest() or {"tables": {}})["tables"].values() for f in folders.values()}
        data = self._path(f"{self.path}/data")
        found = [s.getPath() for s in self._files.listStatus(data)] if self._files.exists(data) else []
        gone = [p for p in found if p.getName() not in named]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)

    def _upserted(self, name: str, rows: DataFrame, keep: tuple[str, ...] = (), old: DataFrame | None = None) -> DataFrame:
        """The table (or its part `old`) with rows put in by key; columns `keep` hold their old value where there is one."""
        keys, old = schemas.KEYS[name], self.table(name) if old is None else old
        rows = rows.dropDuplicates(keys)
        if keep:
            before = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in keep])
            rows = rows.join(before, keys, "left").withColumns({c: F.coalesce(F.col(f"old_{c}"), F.col(c)) for c in keep})
        columns = list(schemas.columns(name))
        return old.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*columns))

    # runs

    def ensure_context(self, context: Context) -> dict[str, DataFrame]:
        now = self.clock()
        one = self.spark.createDataFrame
        project = one([(context.project_id, context.repo_id, context.root, now, now)], schemas.TABLES["project"])
        worktree = one([(context.worktree_id, context.project_id, context.root, now, now)], schemas.TABLES["worktree"])
        scope = one([(context.scope_id, context.project_id, context.worktree_id, context.root, context.parser_version, context.schema_version, context.chunker_version, now, now)], schemas.TABLES["index_scope"])
        return {n: self._upserted(n, rows, ("created_at",)) for n, rows in (("project", project), ("worktree", worktree), ("index_scope", scope))}

    def begin_index_run(self, context: Context) -> str:
        """Appends a run in state `running` and returns its id. Two runs of a scope in one second have one id: an error."""
        from ..functions import ids

        self.init_schema()
        started = self.clock()
        run = ids.run_id(context.scope_id, started)
        if not self.table("index_run").filter(F.col("run_id") == run).isEmpty():
            raise ValueError(f"a run of this scope began in the same second: {run}")
        row = (run, context.repo_id, context.project_id, context.worktree_id, context.scope_id, context.root, "running", context.parser_version, context.schema_version, context.chunker_version, started, None, None, *[0] * 8)
        runs = self.table("index_run").unionByName(self.spark.createDataFrame([row], schemas.TABLES["index_run"]))
        self._write(self.ensure_context(context) | {"index_run": runs})
        return run

    def _set_run(self, run: str, values: dict[str, Column]) -> None:
        runs = self.table("index_run")
        if runs.filter(F.col("run_id") == run).isEmpty():
            raise KeyError(f"index run not found: {run}")
        mine = F.col("run_id") == run
        self._write({"index_run": runs.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in values.items()})})

    def complete_index_run(self, run: str, stats: dict[str, int]) -> None:
        counters = {k: F.lit(stats[k]).cast("long") for k in ("scanned_files", *change.KINDS, "warnings")}
        self._set_run(run, {"status": F.lit("completed"), "finished_at": F.lit(self.clock()), "error": F.lit(None).cast("string")} | counters)

    def fail_index_run(self, run: str, error: str) -> None:
        self._set_run(run, {"status": F.lit("failed"), "finished_at": F.lit(self.clock()), "error": F.lit(error)})

    def run_context(self, run: str) -> dict:
        row = self.table("index_run").filter(F.col("run_id") == run).first()
        if row is None:
            raise KeyError(f"index run not found: {run}")
        return row.asDict()

    # files

    def load_file_fingerprints(self, scope: str) -> DataFrame:
        return self.table("file").filter(F.col("scope_id") == scope).orderBy("relative_path")

    def active_files(self, scope: str) -> DataFrame:
        return self.table("file").filter((F.col("scope_id") == scope) & (F.col("status") == "indexed"))

    def active_file(self, scope: str, path: str) -> str | None:
        """Id of an active file by its path as given."""
        row = self.active_files(scope).filter(F.col("relative_path") == path.replace("\\", "/")).select("file_id").first()
        return row["file_id"] if row else None

    def incremental_plan(self, scan: Scan) -> DataFrame:
        return change.incremental_plan(scan.files, scan.skipped, self.table("file"), scan.context)

    def apply(self, scan: Scan, plan: DataFrame, run: str) -> int:
        """Replaces what changed files have in the graph, marks deleted ones, and commits all at once. Returns the number of warnings."""
        now = self.clock()
        todo = change.changes_of_kind(plan, *change.PARSED).select("file_id")
        files = scan.files.join(todo, "file_id").withColumn("source", source_text(F.col("content")))
        new, context = replaced_files(files, scan.context, run, now), scan.context
        parsed = parse.parse(files, lambda rows: kept(rows, "findings"))
        gone = change.changes_of_kind(plan, "deleted").select("file_id")
        touched = kept(todo.unionByName(gone), "touched")
        buckets = [r["b"] for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # at most self.buckets
        tables = {n: self._touched(n, buckets).join(touched, "file_id", "left_anti").unionByName(_last(rows, n)) for n, rows in (("symbol", parsed.symbols), ("import", parsed.imports), ("chunk", parsed.chunks), ("warning", parsed.warnings))}
        tables["file"] = soft_deleted(self._upserted("file", new, ("created_at",), self._touched("file", buckets)), gone, run, now)
        tables["imports_file"] = without_edges(without_edges(self.table("imports_file"), touched), gone, incoming=True)
        tables["touched_file"] = self._upserted("touched_file", touched.select(F.lit(run).alias("run_id"), "file_id", F.lit(now).alias("touched_at")))
        self._write(tables, touched=buckets)
        at_run = self.table("file").filter((F.col("scope_id") == context.scope_id) & (F.col("last_indexed_run_id") == run)).select("file_id")
        return self.table("warning").join(at_run, "file_id", "left_semi").count()

    def rebuild_scope_import_edges(self, context: Context) -> int:
        """Resolves all imports of the scope anew; returns the number of edges."""
        active = self.active_files(context.scope_id)
        own = self.table("file").filter(F.col("scope_id") == context.scope_id).select(F.col("file_id").alias("from_file_id"))
        edges = resolve.resolve_imports(active, self.table("import"))
        self._write({"imports_file": without_edges(self.table("imports_file"), own.withColumnRenamed("from_file_id", "file_id")).unionByName(edges)})
        return self.table("imports_file").join(own, "from_file_id", "left_semi").count()

    # queries

    def repo_status(self, scan: Scan) -> dict[str, int]:
        return change.repo_status(self.incremental_plan(scan), self.table("file"), scan.context).first().asDict()

    def changed_files(self, scan: Scan) -> DataFrame:
        return change.changed_files(self.incremental_plan(scan))

    def dependencies(self, scope: str) -> DataFrame:
        return graph.dependencies(self.active_files(scope), self.table("imports_file"))

    def neighbors(self, scope: str, path: str) -> tuple[DataFrame, DataFrame] | None:
        return graph.neighbors(self.dependencies(scope), path.replace("\\", "/")) if self.active_file(scope, path) else None

    def impact(self, scope: str, path: str) -> DataFrame | None:
        return graph.impact(self.dependencies(scope), path.replace("\\", "/")) if self.active_file(scope, path) else None

    def explain(self, scope: str, path: str) -> dict[str, DataFrame] | None:
        """The file's row, symbols, imports, outgoing dependencies and warnings, each in order."""
        found = self.active_file(scope, path)
        if not found:
            return None
        files = self.table("file")

        def own(name: str, column: str = "file_id") -> DataFrame:
            return self.table(name).filter(F.col(column) == found)

        return {
            "file": files.filter(F.col("file_id") == found),
            "symbols": own("symbol").orderBy("start_line", "name"),
            "imports": own("import").orderBy("line", "raw_target"),
            "dependencies": graph.dependencies(files, own("imports_file", "from_file_id")).orderBy("to_relative_path"),
            "warnings": own("warning").orderBy("stage", "message"),
        }


def _last(rows: DataFrame, name: str) -> DataFrame:
    """One row a key, the last found; without columns that the table lacks."""
    keys, columns = schemas.KEYS[name], list(schemas.columns(name))
    if "position" not in rows.columns:
        return rows.select(*columns).dropDuplicates(keys)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "position").alias("r")).select("r.*")


def without_edges(edges: DataFrame, files: DataFrame, incoming: bool = False) -> DataFrame:
    """Edges between files without those that go out from `files` (file_id), and, if asked, those that come in."""
    out = edges.join(files.select(F.col("file_id").alias("from_file_id")), "from_file_id", "left_anti")
    if incoming:
        out = out.join(files.select(F.col("file_id").alias("to_file_id")), "to_file_id", "left_anti")
    return out.select(*edges.columns)


def replaced_files(files: DataFrame, context: Context, run: str, now: str) -> DataFrame:
    """Rows of the file table for files indexed now."""
    fixed = {"project_id": context.project_id, "worktree_id": context.worktree_id, "scope_id": context.scope_id, "status": "indexed", "parser_version": context.parser_version, "graph_schema_version": context.schema_version, "chunker_version": context.chunker_version, "last_indexed_run_id": run, "created_at": now, "updated_at": now}
    rows = files.withColumns({k: F.lit(v) for k, v in fixed.items()})
    rows = rows.withColumns({"absolute_path": F.col("path"), "path": F.col("relative_path"), "deleted_at": F.lit(None).cast("string")})
    return rows.select(*schemas.columns("file"))


def soft_deleted(files: DataFrame, gone: DataFrame, run: str, now: str) -> DataFrame:
    """The file table with the files of `gone` marked as deleted; their rows stay."""
    marked = files.join(gone.select("file_id", F.lit(True).alias("is_gone")), "file_id", "left")
    values = {"status": "deleted", "deleted_at": now, "updated_at": now, "last_indexed_run_id": run}
    return marked.withColumns({k: F.when(F.col("is_gone"), v).otherwise(F.col(k)) for k, v in values.items()}).drop("is_gone").select(*files.columns)
