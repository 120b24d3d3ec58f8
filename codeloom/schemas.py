"""Fixed schemas: what the store keeps, and what scans and plans return."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "codeloom-graph-v1"
#: Fixed version labels of the parsing and chunking rules.
PARSER_VERSION, CHUNKER_VERSION = "parser-heuristic-v2", "symbol-range-v1"


#: The store's tables. Containment relations are foreign keys: worktree.project_id,
#: index_scope.worktree_id, file.scope_id, symbol/import/chunk/warning.file_id, chunk.symbol_id.
TABLES: dict[str, str] = {
    "schema_meta": "key string, value string",
    "project": "project_id string, repo_id string, root_path string, created_at string, updated_at string",
    "worktree": "worktree_id string, project_id string, root_path string, created_at string, updated_at string",
    "index_scope": "scope_id string, project_id string, worktree_id string, repo_root string, parser_version string, graph_schema_version string, chunker_version string, created_at string, updated_at string",
    "file": "file_id string, repo_id string, project_id string, worktree_id string, scope_id string, path string, relative_path string, absolute_path string, language string, sha256 string, size_bytes long, mtime_seconds long, status string, parser_version string, graph_schema_version string, chunker_version string, last_indexed_run_id string, created_at string, updated_at string, deleted_at string",
    "symbol": "symbol_id string, file_id string, file_path string, name string, kind string, language string, start_line long, end_line long",
    "import": "import_id string, file_id string, raw_target string, line long",
    "chunk": "chunk_id string, file_id string, symbol_id string, label string, start_line long, end_line long",
    "warning": "warning_id string, file_id string, file_path string, stage string, message string",
    "index_run": "run_id string, repo_id string, project_id string, worktree_id string, scope_id string, repo_root string, status string, parser_version string, graph_schema_version string, chunker_version string, started_at string, finished_at string, error string, scanned_files long, added long, modified long, unchanged long, deleted long, skipped long, reindex_needed long, warnings long",
    "imports_file": "from_file_id string, to_file_id string, raw_target string, confidence_score double, confidence_label string, evidence string",
    "touched_file": "run_id string, file_id string, touched_at string",
}
#: Tables that are kept in buckets of files.
BY_FILE = ("file", "symbol", "import", "chunk", "warning")


def columns(table: str) -> dict[str, str]:
    """Columns of a table with their types."""
    return dict(c.split(" ") for c in TABLES[table].split(", "))


KEYS = {"schema_meta": ["key"], "project": ["project_id"], "worktree": ["worktree_id"], "index_scope": ["scope_id"], "file": ["file_id"], "symbol": ["symbol_id"], "import": ["import_id"], "chunk": ["chunk_id"], "warning": ["warning_id"], "index_run": ["run_id"], "imports_file": ["from_file_id", "to_file_id"], "touched_file": ["run_id", "file_id"]}

#: Relations of the graph as (parent key, child key) views over the tables.
RELATIONS = {
    "has_worktree": ("worktree", "project_id", "worktree_id"),
    "has_scope": ("index_scope", "worktree_id", "scope_id"),
    "contains_file": ("file", "scope_id", "file_id"),
    "defines": ("symbol", "file_id", "symbol_id"),
    "has_import": ("import", "file_id", "import_id"),
    "has_chunk": ("chunk", "file_id", "chunk_id"),
    "symbol_has_chunk": ("chunk", "symbol_id", "chunk_id"),
    "has_warning": ("warning", "file_id", "warning_id"),
}

ENTRIES = T.StructType([T.StructField("relative_path", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("mtime_seconds", T.LongType()), T.StructField("content", T.BinaryType())])
