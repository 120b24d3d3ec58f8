"""Queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no source code, so each query derives a virtual source tree from
them with expressions that both engines read (the strings below), and then runs
the engine's own operators on it. SQL works on the same strings by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Context
from .functions import text
from .operators import change, graph, parse, resolve, scan
from .operators.scan import Scan
from .plans import store

Query = Callable[[SparkSession, str], DataFrame]

ROOT = "/virtual"
CONTEXT = Context(ROOT, "repo", "project", "worktree", "scope", parser_version="p2", schema_version="g1", chunker_version="c1")

#: One Rust file a part; each imports one other, and declares what the rules look for.
RUST_PATH = "'src/m' || CAST(p_partkey AS STRING) || '.rs'"
RUST_TEXT = """'use crate::m' || CAST((p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS STRING) || '::Item;' || chr(10)
 || 'mod helper' || CAST(p_size AS STRING) || ' ;' || chr(10)
 || 'pub struct ' || replace(p_brand, '#', '_') || ' {' || chr(10) || '}' || chr(10)
 || 'enum E' || CAST(p_size AS STRING) || ' { A }' || chr(10) || 'pub trait T {}' || chr(10)
 || 'impl S' || CAST(p_size AS STRING) || ' {' || chr(10) || '    pub fn f' || CAST(p_partkey % 5 AS STRING) || '(&self) {' || chr(10)
 || '    }' || chr(10) || '}' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'impl A for B {}' || chr(10) ELSE '' END
 || 'fn main() {' || chr(10) || '}' || chr(13) || chr(10) || 'fn last() {}'"""
#: One file a part in seven kinds, one of them unknown.
MIXED_PATH = """'src/' || replace(p_brand, '#', '_') || '/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.tsx' WHEN 4 THEN '.java' WHEN 5 THEN '.go' ELSE '.md' END"""
MIXED_TEXT = """CASE p_partkey % 7
 WHEN 0 THEN 'use std::fs;' || chr(10) || 'fn a' || CAST(p_size AS STRING) || '() {}' || chr(10)
 WHEN 1 THEN 'import os, sys ' || chr(10) || 'from pkg.a import b' || CAST(p_size AS STRING) || chr(10) || 'class C' || CAST(p_partkey AS STRING) || ':' || chr(10) || '    def run(self):' || chr(10)
 WHEN 4 THEN 'import java.util.List;' || chr(10) || 'public class J' || CAST(p_partkey AS STRING) || ' {' || chr(10) || '  public int size() {' || chr(10) || '    return call(1);' || chr(10) || 'interface I {' || chr(10)
 WHEN 5 THEN 'package main' || chr(10) || 'import "fmt"' || chr(10) || '  "os"' || chr(10) || 'func (r *R) M' || CAST(p_size AS STRING) || '() {}' || chr(10) || 'func F() {}' || chr(10) || 'type T struct {' || chr(10) || 'type W interface {' || chr(10)
 ELSE 'import { a } from "./m' || CAST(p_size AS STRING) || '";' || chr(10) || 'const fs = require("fs");' || chr(10) || 'export function g() {}' || chr(10) || 'export class K' || CAST(p_partkey AS STRING) || ' {}' || chr(10) || 'const h = async (x) => x;' || chr(10) END
 || CASE WHEN p_partkey % 11 = 0 THEN '<<parse-error>>' || chr(10) ELSE '' END"""
LANGUAGE = "CASE p_partkey % 7 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'java' WHEN 5 THEN 'go' ELSE 'unknown' END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str, path: str, body: str, where: str = "true") -> DataFrame:
    """Part rows as file entries. The number of files is asked for once."""
    part = _table(spark, sf_dir, "part")
    body = body.replace("(SELECT count(*) FROM part)", str(part.count()))
    rows = part.filter(where).select(F.expr(path).alias("relative_path"), F.expr(body).alias("source"))
    return rows.select("relative_path", F.concat(F.lit(ROOT + "/"), "relative_path").alias("path"), F.octet_length("source").cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_seconds"), F.col("source").cast("binary").alias("content"))


def _scan(spark: SparkSession, sf_dir: str, path: str = RUST_PATH, body: str = RUST_TEXT) -> Scan:
    return scan.scan_entries(_entries(spark, sf_dir, path, body), CONTEXT)


def _sourced(found: Scan) -> DataFrame:
    return found.files.withColumn("source", scan.source_text(F.col("content")))


def _rust(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, parse.Parsed]:
    files = _sourced(_scan(spark, sf_dir))
    return files, parse.parse(files)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, parse.Parsed]:
    files = _sourced(_scan(spark, sf_dir, MIXED_PATH, MIXED_TEXT))
    return files, parse.parse(files)


def _hash(*parts: str) -> str:
    """Stable hash of SQL expressions."""
    return "sha256(" + " || ".join(f"{p} || chr(0)" for p in parts) + ")"


def scan_fingerprints(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    entries = docs.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("relative_path"), F.lit("p").alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("mtime_seconds"), F.col("text").cast("binary").alias("content"))
    return scan.scan_entries(entries, CONTEXT).files.select("file_id", "relative_path", "language", "sha256", "size_bytes", "mtime_seconds")


SCAN_FINGERPRINTS = f"""
SELECT {_hash("'project'", "'scope'", "relative_path")} AS file_id, relative_path, 'python' AS language, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, CAST(0 AS BIGINT) AS mtime_seconds
FROM (SELECT 'src/d' || doc_id || '.py' AS relative_path, text FROM documents) WHERE octet_length(encode(text)) <= 1048576"""

CLASSES = """CASE WHEN p_partkey % 5 = 0 THEN 'target/x' ELSE 'src/x' END || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '.md' ELSE '.rs' END"""


def skip_classification(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name").cast("binary"), F.lit(b"\0"))).otherwise(F.col("p_name").cast("binary"))
    entries = part.select(F.expr(CLASSES).alias("relative_path"), F.lit("p").alias("path"), (F.col("p_size") * 10).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_seconds"), body.alias("content"))
    found = scan.classify(entries, Config(max_file_size_bytes=400))
    listed = F.coalesce("reason", F.when(F.col("language") == "unknown", "omitted").otherwise("indexed"))
    return found.select("relative_path", "language", listed.alias("outcome"))


SKIP_CLASSIFICATION = f"""
SELECT relative_path, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'rust' END AS language,
  CASE WHEN p_size * 10 > 400 THEN 'oversized' WHEN p_partkey % 3 = 0 THEN 'binary' WHEN p_partkey % 4 = 0 THEN 'omitted' ELSE 'indexed' END AS outcome
FROM (SELECT *, {CLASSES} AS relative_path FROM part) WHERE p_partkey % 5 <> 0"""


def language_summary(spark, sf_dir):
    return graph.language_summary(_scan(spark, sf_dir, MIXED_PATH, MIXED_TEXT).files)


LANGUAGE_SUMMARY = f"SELECT {LANGUAGE} AS language, count(*) AS files FROM part WHERE p_partkey % 7 <> 6 GROUP BY 1"


def language_detect(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", scan.language(F.expr(MIXED_PATH)).alias("language"), text.extension(F.expr(MIXED_PATH)).alias("extension"), text.stem(F.expr(MIXED_PATH)).alias("stem"), text.parent(F.expr(MIXED_PATH)).alias("parent"))


LANGUAGE_DETECT = f"""
SELECT p_partkey, {LANGUAGE} AS language, CASE p_partkey % 7 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'js' WHEN 3 THEN 'tsx' WHEN 4 THEN 'java' WHEN 5 THEN 'go' ELSE 'md' END AS extension,
  'f' || p_partkey AS stem, 'src/' || replace(p_brand, '#', '_') AS parent FROM part"""


def directory_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return graph.directory_summary(docs.select(path.alias("relative_path")))


DIRECTORY_SUMMARY = "SELECT CASE WHEN doc_id % 9 = 0 THEN '.' ELSE source || '/' || lang END AS directory, count(*) AS files FROM documents GROUP BY 1"


def line_explode(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


LINE_EXPLODE = r"""
SELECT doc_id, CAST(n AS BIGINT) AS line_no, regexp_replace(l[n], CASE WHEN n < len(l) THEN '\r$' ELSE '$^' END, '') AS line
FROM (SELECT doc_id, l, unnest(range(1, CASE WHEN l[len(l)] = '' THEN len(l) ELSE len(l) + 1 END)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

#: Lines of the virtual files, in SQL.
_LINES = """l AS (SELECT path, language, n, CASE WHEN n < len(s) THEN regexp_replace(s[n], '\\r$', '') ELSE s[n] END AS line
  FROM (SELECT path, language, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT path, language, string_split(body, chr(10)) AS s FROM v)))"""
_ID = "[A-Za-z_][A-Za-z0-9_]*"
_IMPL = f"^\\s*impl(?:\\s+[^ ]+)?\\s+({_ID})"
#: Lines inside an impl block: an automaton that walks each file line by line.
_INSIDE = f"""walk AS (SELECT path, 0 AS n, CAST(0 AS BIGINT) AS depth, false AS is_open, false AS was_open FROM v
  UNION ALL SELECT path, n, CASE WHEN header OR (is_open AND moved > 0) THEN moved ELSE 0 END, header OR (is_open AND moved > 0), is_open
  FROM (SELECT l.path, l.n, w.is_open, regexp_matches(l.line, '{_IMPL}') AS header, w.depth + length(replace(l.line, '}}', '')) - length(replace(l.line, '{{', '')) AS moved FROM walk w JOIN l ON l.path = w.path AND l.n = w.n + 1)),
inside AS (SELECT path, n FROM walk WHERE was_open)"""
_RUST = f"WITH RECURSIVE v AS (SELECT {RUST_PATH} AS path, 'rust' AS language, {RUST_TEXT} AS body FROM part), {_LINES}, {_INSIDE}"
_MIXED = f"WITH v AS (SELECT {MIXED_PATH} AS path, {LANGUAGE} AS language, {MIXED_TEXT} AS body FROM part WHERE p_partkey % 7 <> 6), {_LINES}"
_GOOD = "path NOT IN (SELECT path FROM v WHERE contains(body, '<<parse-error>>') AND language IN ('rust', 'python', 'javascript', 'typescript'))"
_FILE = _hash("'project'", "'scope'", "path")


def _found(language: str, pattern: str, kind: str, group: int = 1, more: str = "") -> str:
    pattern = "^\\s*" + pattern.replace("'", "''")
    return f"SELECT path, language, n, '{kind}' AS kind, regexp_extract(line, '{pattern}', {group}) AS name, line FROM l WHERE language IN ({language}) AND regexp_matches(line, '{pattern}') AND {_GOOD} {more}"


def _symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol_id", "file_id", "file_path", "name", "kind", "language", F.col("start_line").cast("long").alias("start_line"))


def _imports(df: DataFrame) -> DataFrame:
    return df.select("import_id", "file_id", "raw_target", F.col("line").cast("long").alias("line"))


def _symbols_sql(head: str, parts: list[str]) -> str:
    return f"""{head} SELECT {_hash("path", "name", "CAST(n AS VARCHAR)", "CAST(n AS VARCHAR)")} AS symbol_id, {_FILE} AS file_id, path AS file_path, name, kind, language, CAST(n AS BIGINT) AS start_line FROM ({" UNION ALL ".join(parts)})"""


def _imports_sql(head: str, parts: list[str]) -> str:
    return f"""{head} SELECT {_hash("file_id", "raw_target", "CAST(n AS VARCHAR)")} AS import_id, file_id, raw_target, CAST(n AS BIGINT) AS line FROM (SELECT {_FILE} AS file_id, trim(name) AS raw_target, n FROM ({" UNION ALL ".join(parts)}))"""


def rust_symbols(spark, sf_dir):
    return _symbols(_rust(spark, sf_dir)[1].symbols)


_FN = "(?:pub\\s+)?fn\\s+(" + _ID + ")"
_RUST_SYMBOLS = [
    _found("'rust'", f"mod\\s+({_ID})\\s*;", "Module"),
    _found("'rust'", f"(?:pub\\s+)?struct\\s+({_ID})", "Struct"),
    _found("'rust'", f"(?:pub\\s+)?enum\\s+({_ID})", "Enum"),
    _found("'rust'", f"(?:pub\\s+)?trait\\s+({_ID})", "Trait"),
    _found("'rust'", f"impl(?:\\s+[^ ]+)?\\s+({_ID})", "Type"),
]
_METHODS = [_found("'rust'", _FN, "Method", more="AND (path, n) IN (SELECT path, n FROM inside)"), _found("'rust'", _FN, "Function", more="AND (path, n) NOT IN (SELECT path, n FROM inside)")]
RUST_SYMBOLS = _symbols_sql(_RUST, [*_RUST_SYMBOLS, *_METHODS])


def rust_imports(spark, sf_dir):
    return _imports(_rust(spark, sf_dir)[1].imports)


RUST_IMPORTS = _imports_sql(_RUST, [_found("'rust'", "use\\s+([^;]+);", ""), _found("'rust'", f"mod\\s+({_ID})\\s*;", "")])


def impl_scope_methods(spark, sf_dir):
    return _rust(spark, sf_dir)[1].symbols.filter("kind IN ('Method', 'Function')").groupBy("file_path").agg(F.count_if(F.col("kind") == "Method").alias("methods"), F.count_if(F.col("kind") == "Function").alias("functions"))


IMPL_SCOPE_METHODS = f"""{_RUST} SELECT path AS file_path, count(*) FILTER (kind = 'Method') AS methods, count(*) FILTER (kind = 'Function') AS functions FROM ({" UNION ALL ".join(_METHODS)}) GROUP BY path"""


def _of(language: tuple[str, ...]) -> tuple[Query, Query]:
    def symbols(spark, sf_dir):
        return _symbols(_mixed(spark, sf_dir)[1].symbols.filter(F.col("language").isin(*language)))

    def imports(spark, sf_dir):
        files, parsed = _mixed(spark, sf_dir)
        return _imports(parsed.imports.join(files.filter(F.col("language").isin(*language)).select("file_id"), "file_id", "left_semi"))

    return symbols, imports


_SCRIPT = "'javascript', 'typescript'"
_BY_LANGUAGE = {
    "python": (("python",), [_found("'python'", f"class\\s+({_ID})", "Class"), _found("'python'", f"def\\s+({_ID})", "Function")], [_found("'python'", "import\\s+(.+)$", ""), f"SELECT path, language, n, '' AS kind, trim(regexp_extract(line, '^\\s*from\\s+(.+)\\s+import\\s+(.+)$', 1)) || '::' || trim(regexp_extract(line, '^\\s*from\\s+(.+)\\s+import\\s+(.+)$', 2)) AS name, line FROM l WHERE language = 'python' AND regexp_matches(line, '^\\s*from\\s+(.+)\\s+import\\s+(.+)$') AND {_GOOD}"]),
    "js": (("javascript", "typescript"), [_found(_SCRIPT, f"(?:export\\s+)?function\\s+({_ID})", "Function"), _found(_SCRIPT, f"(?:export\\s+)?class\\s+({_ID})", "Class"), _found(_SCRIPT, f"(?:export\\s+)?const\\s+({_ID})\\s*=\\s*(?:async\\s+)?\\(", "Function")], [_found(_SCRIPT, "import\\s+.*?from\\s+[\"']([^\"']+)[\"']", ""), _found(_SCRIPT, f"(?:const|let|var)\\s+{_ID}\\s*=\\s*require\\([\"']([^\"']+)[\"']\\)", "")]),
    "java": (("java",), [_found("'java'", f"(?:public\\s+)?class\\s+({_ID})", "Class"), _found("'java'", f"(?:public\\s+)?interface\\s+({_ID})", "Interface"), _found("'java'", f"(?:public|private|protected)?\\s*(?:static\\s+)?[A-Za-z0-9_<>\\[\\]]+\\s+({_ID})\\s*\\(", "Method")], [_found("'java'", "import\\s+([^;]+);", "")]),
    "go": (("go",), [_found("'go'", f"func\\s+\\([^)]+\\)\\s+({_ID})\\s*\\(", "Method"), _found("'go'", f"func\\s+({_ID})\\s*\\(", "Function"), _found("'go'", f"type\\s+({_ID})\\s+struct", "Struct"), _found("'go'", f"type\\s+({_ID})\\s+interface", "Interface")], [_found("'go'", '"([^"]+)"', "")]),
}


def chunks(spark, sf_dir):
    return _mixed(spark, sf_dir)[1].chunks.select("chunk_id", "file_id", "symbol_id", "label", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


_MIXED_SYMBOLS = " UNION ALL ".join([*_RUST_SYMBOLS, _found("'rust'", _FN, "Function"), *[p for _, s, _ in _BY_LANGUAGE.values() for p in s]])
CHUNKS = f"""{_MIXED} SELECT {_hash("file_id", "name", "CAST(n AS VARCHAR)", "CAST(n AS VARCHAR)")} AS chunk_id, file_id, {_hash("path", "name", "CAST(n AS VARCHAR)", "CAST(n AS VARCHAR)")} AS symbol_id, 'symbol:' || name AS label, CAST(n AS BIGINT) AS start_line, CAST(n AS BIGINT) AS end_line FROM (SELECT *, {_FILE} AS file_id FROM ({_MIXED_SYMBOLS}))"""


def warnings(spark, sf_dir):
    return _mixed(spark, sf_dir)[1].warnings


WARNINGS = f"""{_MIXED} SELECT {_hash("path", "'parse'", "message")} AS warning_id, {_FILE} AS file_id, path AS file_path, 'parse' AS stage, message
FROM (SELECT path, 'forced ' || CASE language WHEN 'rust' THEN 'rust' WHEN 'python' THEN 'python' ELSE 'js' END || ' parser failure' AS message FROM v WHERE contains(body, '<<parse-error>>') AND language IN ('rust', 'python', 'javascript', 'typescript'))"""

#: Orders as file states: scanned unless the key is a multiple of 13; stored unless of 11.
_SHA = "CAST(o_custkey AS STRING)"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".rs")).alias("relative_path"), F.expr(_SHA).alias("sha256"), F.col("o_custkey").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_seconds"))
    from .functions import ids

    orders = orders.withColumn("file_id", ids.file_id(CONTEXT.project_id, CONTEXT.scope_id, F.col("relative_path")))
    k = F.col("o_orderkey")
    files = orders.filter(k % 13 != 0)
    stored = orders.filter(k % 11 != 0).withColumns({"sha256": F.when(k % 7 == 0, "old").otherwise(F.col("sha256")), "status": F.when(k % 17 == 0, "deleted").otherwise("indexed"), "parser_version": F.when(k % 5 == 0, "p1").otherwise("p2"), "graph_schema_version": F.lit("g1"), "chunker_version": F.lit("c1"), "scope_id": F.lit("scope")})
    skipped = orders.filter(k % 97 == 0).select("relative_path", F.lit("oversized").alias("reason"))
    return files, skipped, stored


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, skipped, stored = _states(spark, sf_dir)
    return change.incremental_plan(files, skipped, stored, CONTEXT)


def incremental_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("file_id", "relative_path", "kind", "previous_sha256", "current_sha256", "reason")


_STATES = f"""WITH o AS (SELECT o_orderkey AS k, 'src/o' || o_orderkey || '.rs' AS path, {_SHA} AS sha FROM orders),
f AS (SELECT * FROM o WHERE k % 13 <> 0), s AS (SELECT k, path, CASE WHEN k % 7 = 0 THEN 'old' ELSE sha END AS sha, k % 17 = 0 AS gone, k % 5 = 0 AS outdated FROM o WHERE k % 11 <> 0),
p AS (SELECT {_FILE} AS file_id, path AS relative_path, kind, previous_sha256, current_sha256, reason FROM (
  SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.k IS NULL THEN 'deleted' WHEN s.k IS NULL OR s.gone THEN 'added' WHEN s.sha <> f.sha THEN 'modified' WHEN s.outdated THEN 'reindex_needed' ELSE 'unchanged' END AS kind,
    s.sha AS previous_sha256, f.sha AS current_sha256, CASE WHEN f.k IS NOT NULL AND s.gone THEN 'previously soft-deleted' WHEN f.k IS NOT NULL AND s.k IS NOT NULL AND s.sha = f.sha AND s.outdated THEN 'version mismatch' END AS reason
  FROM f FULL JOIN s ON f.k = s.k WHERE f.k IS NOT NULL OR NOT s.gone)
  UNION ALL SELECT {_hash("path")}, path, 'skipped', NULL, NULL, 'oversized' FROM o WHERE k % 97 = 0)"""
INCREMENTAL_PLAN = _STATES + " SELECT * FROM p"


def plan_stats(spark, sf_dir):
    return change.plan_stats(_plan(spark, sf_dir))


PLAN_STATS = _STATES + " SELECT CAST(0 AS BIGINT) AS scanned_files, CAST(0 AS BIGINT) AS warnings, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in change.KINDS) + " FROM p"


def changed_files(spark, sf_dir):
    return change.changed_files(_plan(spark, sf_dir)).select("relative_path", "kind")


CHANGED_FILES = _STATES + " SELECT relative_path, kind FROM p WHERE kind <> 'unchanged'"


def changes_of_kind(spark, sf_dir):
    return change.changes_of_kind(_plan(spark, sf_dir), *change.PARSED).select("file_id", "kind")


CHANGES_OF_KIND = _STATES + " SELECT file_id, kind FROM p WHERE kind IN ('added', 'modified', 'reindex_needed')"


def repo_status(spark, sf_dir):
    return change.repo_status(_plan(spark, sf_dir), _states(spark, sf_dir)[2], CONTEXT)


REPO_STATUS = _STATES + " SELECT (SELECT count(*) FROM s WHERE NOT gone) AS tracked_files, (SELECT count(*) FROM f) AS scan_files, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in change.KINDS) + " FROM p"


def soft_delete(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file_id"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("deleted_at"), F.lit("1").alias("updated_at"), F.lit("r1").alias("last_indexed_run_id"))
    gone = _table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 9 == 0).select(F.col("o_orderkey").cast("string").alias("file_id"))
    return store.soft_deleted(orders, gone, "r2", "2")


SOFT_DELETE = "SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE WHEN g THEN 'deleted' ELSE 'indexed' END AS status, CASE WHEN g THEN '2' END AS deleted_at, CASE WHEN g THEN '2' ELSE '1' END AS updated_at, CASE WHEN g THEN 'r2' ELSE 'r1' END AS last_indexed_run_id FROM (SELECT o_orderkey, o_orderkey % 9 = 0 AS g FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, parsed = _rust(spark, sf_dir)
    files = files.select("file_id", "relative_path", "language")
    return files, resolve.resolve_imports(files, parsed.imports)


def resolve_imports(spark, sf_dir):
    return _edges(spark, sf_dir)[1]


_E = "e AS (SELECT p_partkey AS a, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS b FROM part)"


def _key(k: str) -> str:
    return _hash("'project'", "'scope'", f"'src/m' || CAST({k} AS VARCHAR) || '.rs'")


_HAVE = "b IN (SELECT p_partkey FROM part)"
RESOLVE_IMPORTS = f"WITH {_E} SELECT {_key('a')} AS from_file_id, {_key('b')} AS to_file_id, 'crate::m' || b || '::Item' AS raw_target, 1.0::DOUBLE AS confidence_score, 'high' AS confidence_label, 'rust module path resolved to local file' AS evidence FROM e WHERE {_HAVE}"


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(*_edges(spark, sf_dir))


def dependencies(spark, sf_dir):
    return _deps(spark, sf_dir).select("from_relative_path", "to_relative_path", "raw_target")


DEPENDENCIES = f"WITH {_E} SELECT 'src/m' || a || '.rs' AS from_relative_path, 'src/m' || b || '.rs' AS to_relative_path, 'crate::m' || b || '::Item' AS raw_target FROM e WHERE {_HAVE}"


def export_edges(spark, sf_dir):
    files, parsed = _mixed(spark, sf_dir)
    edges = graph.export_edges(files.select("file_id", "relative_path"), parsed.symbols, parsed.imports)
    return edges.select("edge_id", "from_id", "to_id", "kind", F.col("confidence.label").alias("label"), F.col("evidence.source").alias("source"), F.col("evidence.detail").alias("detail"))


_MIXED_IMPORTS = " UNION ALL ".join([_found("'rust'", "use\\s+([^;]+);", ""), *[p for _, _, i in _BY_LANGUAGE.values() for p in i]])
_EXPORT = f"""{_MIXED}, y AS (SELECT {_FILE} AS file_id, {_hash("path", "name", "CAST(n AS VARCHAR)", "CAST(n AS VARCHAR)")} AS symbol_id, name FROM ({_MIXED_SYMBOLS})), i AS (SELECT {_FILE} AS file_id, trim(name) AS t FROM ({_MIXED_IMPORTS})),
x AS (SELECT file_id AS from_id, symbol_id AS to_id, 'Defines' AS kind, 'defines' AS snake, 'defines:' || name AS detail FROM y
  UNION ALL SELECT symbol_id, file_id, 'BelongsTo', 'belongs_to', 'belongs_to:' || name FROM y
  UNION ALL SELECT file_id, {_hash("t")}, 'Imports', 'imports', 'imports:' || t FROM i)"""
EXPORT_EDGES = f"""{_EXPORT} SELECT {_hash("from_id", "to_id", "snake", "detail")} AS edge_id, from_id, to_id, kind, 'high' AS label, 'heuristic-parser' AS source, detail FROM x"""


def imports_summary(spark, sf_dir):
    files, parsed = _mixed(spark, sf_dir)
    return graph.imports_summary(graph.export_edges(files.select("file_id", "relative_path"), parsed.symbols, parsed.imports))


IMPORTS_SUMMARY = f"{_EXPORT} SELECT detail, count(*) AS imports FROM x WHERE kind = 'Imports' GROUP BY detail"


def run_history(spark, sf_dir):
    """Two runs over a store of their own, with a fixed clock: one completed, one failed."""
    from .plans.shared import scratch

    ticks = iter(range(100, 200))
    held = store.GraphStore(spark, scratch(spark, "runs"), lambda: str(next(ticks)))
    first = held.begin_index_run(CONTEXT)
    held.complete_index_run(first, dict.fromkeys(("scanned_files", *change.KINDS, "warnings"), 3))
    held.fail_index_run(held.begin_index_run(CONTEXT), "unreadable")
    return held.table("index_run").select("run_id", "status", "started_at", "error", "added", "warnings")


def _run(started: str) -> str:
    return _hash("'scope'", f"'{started}'", "'index-run'")


RUN_HISTORY = f"SELECT {_run('100')} AS run_id, 'completed' AS status, '100' AS started_at, NULL::VARCHAR AS error, 3::BIGINT AS added, 3::BIGINT AS warnings UNION ALL SELECT {_run('103')}, 'failed', '103', 'unreadable', 0, 0"

_SQL = {
    "scan_fingerprints": (scan_fingerprints, SCAN_FINGERPRINTS),
    "skip_classification": (skip_classification, SKIP_CLASSIFICATION),
    "language_detect": (language_detect, LANGUAGE_DETECT),
    "language_summary": (language_summary, LANGUAGE_SUMMARY),
    "directory_summary": (directory_summary, DIRECTORY_SUMMARY),
    "line_explode": (line_explode, LINE_EXPLODE),
    "rust_symbols": (rust_symbols, RUST_SYMBOLS),
    "rust_imports": (rust_imports, RUST_IMPORTS),
    "impl_scope_methods": (impl_scope_methods, IMPL_SCOPE_METHODS),
    "chunks": (chunks, CHUNKS),
    "warnings": (warnings, WARNINGS),
    "incremental_plan": (incremental_plan, INCREMENTAL_PLAN),
    "plan_stats": (plan_stats, PLAN_STATS),
    "changed_files": (changed_files, CHANGED_FILES),
    "changes_of_kind": (changes_of_kind, CHANGES_OF_KIND),
    "repo_status": (repo_status, REPO_STATUS),
    "soft_delete": (soft_delete, SOFT_DELETE),
    "resolve_imports": (resolve_imports, RESOLVE_IMPORTS),
    "dependencies": (dependencies, DEPENDENCIES),
    "export_edges": (export_edges, EXPORT_EDGES),
    "imports_summary": (imports_summary, IMPORTS_SUMMARY),
    "run_history": (run_history, RUN_HISTORY),
}
for _name, (_languages, _s, _i) in _BY_LANGUAGE.items():
    _q = _of(_languages)
    _SQL[f"{_name}_symbols"] = (_q[0], _symbols_sql(_MIXED, _s))
    _SQL[f"{_name}_imports"] = (_q[1], _imports_sql(_MIXED, _i))


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _SQL.items()}
