import random

import pytest
from pyspark.sql import functions as F

from codeloom.config import Context
from codeloom.operators import change, graph, resolve

CONTEXT = Context("/r", "repo", "project", "worktree", "scope", parser_version="p2", schema_version="g", chunker_version="c")


def test_plan_cases(spark):
    stored = [
        ("same", "s", "indexed", "p2"), ("changed", "old", "indexed", "p2"), ("back", "s", "deleted", "p2"), ("outdated", "s", "indexed", "p1"), ("gone", "s", "indexed", "p2"), ("long_gone", "s", "deleted", "p2"), ("both", "old", "indexed", "p1"), ("now_binary", "s", "indexed", "p2"),
    ]
    rows = [(f, "scope", f, sha, 1, 1, status, version, "g", "c") for f, sha, status, version in stored] + [("other", "elsewhere", "other", "s", 1, 1, "indexed", "p2", "g", "c")]
    old = spark.createDataFrame(rows, "file_id string, scope_id string, relative_path string, sha256 string, size_bytes long, mtime_seconds long, status string, parser_version string, graph_schema_version string, chunker_version string")
    new = spark.createDataFrame([(f, f, "s", 9, 9) for f in ("same", "changed", "back", "outdated", "both", "new")], "file_id string, relative_path string, sha256 string, size_bytes long, mtime_seconds long")
    skipped = spark.createDataFrame([("now_binary", "binary")], "relative_path string, reason string")
    plan = change.incremental_plan(new, skipped, old, CONTEXT)
    found = sorted((r["relative_path"], r["kind"], r["previous_sha256"], r["current_sha256"], r["reason"]) for r in plan.collect() if True)
    assert found == sorted(
        [
            ("same", "unchanged", "s", "s", None), ("changed", "modified", "old", "s", None), ("back", "added", "s", "s", "previously soft-deleted"), ("outdated", "reindex_needed", "s", "s", "version mismatch"),
            ("both", "modified", "old", "s", None), ("new", "added", None, "s", None), ("gone", "deleted", "s", None, None), ("now_binary", "deleted", "s", None, None), ("now_binary", "skipped", None, None, "binary"),
        ],
        key=lambda x: (x[0], x[1]),
    )
    assert [(r["relative_path"], r["kind"]) for r in change.changed_files(plan).collect()] == [("back", "added"), ("both", "modified"), ("changed", "modified"), ("gone", "deleted"), ("new", "added"), ("now_binary", "deleted"), ("now_binary", "skipped"), ("outdated", "reindex_needed")]
    status = change.repo_status(plan, old, CONTEXT).first().asDict()
    assert status == {"tracked_files": 6, "scan_files": 6, "added": 2, "modified": 2, "deleted": 2, "unchanged": 1, "skipped": 1, "reindex_needed": 1}


@pytest.mark.parametrize(
    ("target", "module"),
    [
        ("crate::{db::X, a}", "db"), ("crate::{a, db}", "a, db"), ("std::fs", None), ("crate::core::x", None), ("super::*", None), ("db as d", "db as d"), ("{self}", "self"), ("super::super::x", "super"),
        ("self::b::c", "b"), ("  auth  ", "auth"), ("", None), ("alloc::x", None), ("::x", None),
    ],
)
def test_module_names(spark, target, module):
    assert spark.createDataFrame([(target,)], "t string").select(resolve.module_name(F.col("t"))).first()[0] == module


def edges_of(spark, files, imports):
    f = spark.createDataFrame([(p, p, "rust" if p.endswith(".rs") else "python") for p in files], "file_id string, relative_path string, language string")
    i = spark.createDataFrame([(a, t, n) for n, (a, t) in enumerate(imports)], "file_id string, raw_target string, line int")
    return sorted((r["from_file_id"], r["to_file_id"], r["raw_target"]) for r in resolve.resolve_imports(f, i).collect())


def test_candidate_order(spark):
    files = ["a/m.rs", "a/m/x.rs", "a/m/x/mod.rs", "a/x.rs", "a/x/mod.rs", "src/x.rs", "src/x/mod.rs"]
    for i in range(1, len(files)):
        assert edges_of(spark, [files[0], *files[i:]], [("a/m.rs", "x::Y")]) == [("a/m.rs", files[i], "x::Y")]
    assert edges_of(spark, ["src/main.rs", "src/main/x.rs"], [("src/main.rs", "x")]) == []
    assert edges_of(spark, ["x.rs", "y.rs"], [("x.rs", "y")]) == [("x.rs", "y.rs", "y")]


def test_first_import_wins_and_self_edges(spark):
    imports = [("src/a.rs", "b::X"), ("src/a.rs", "crate::b::Y"), ("src/a.rs", "crate::a::Z"), ("m.py", "b")]
    assert edges_of(spark, ["src/a.rs", "src/b.rs", "m.py"], imports) == [("src/a.rs", "src/a.rs", "crate::a::Z"), ("src/a.rs", "src/b.rs", "b::X")]


def queue_search(edges, start):
    incoming = {}
    for a, b in sorted(edges):
        incoming.setdefault(b, []).append(a)
    seen, queue, out = set(), [(start, 0)], []
    for path, depth in queue:
        for a in incoming.get(path, ()):
            if a not in seen:
                seen.add(a)
                queue.append((a, depth + 1))
                out.append((depth + 1, a, path))
    return sorted(out, key=lambda x: (x[0], x[1].split("/")))


def deps_of(spark, edges):
    return spark.createDataFrame([(a, b, a, b) for a, b in edges], "from_file_id string, to_file_id string, from_relative_path string, to_relative_path string")


@pytest.mark.parametrize("seed", range(3))
def test_impact_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"{rng.choice('ab')}{rng.choice(['/', '-', '.'])}{i}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    found = [(r["depth"], r["relative_path"], r["via_relative_path"]) for r in graph.impact(deps_of(spark, edges), names[0]).collect()]
    assert found == queue_search(edges, names[0])


def test_impact_of_a_lonely_file(spark):
    assert graph.impact(deps_of(spark, [("a", "b")]), "a").collect() == []


def test_neighbors(spark):
    outgoing, incoming = graph.neighbors(deps_of(spark, [("a", "b"), ("c", "a"), ("b", "a")]), "a")
    assert [r["to_relative_path"] for r in outgoing.collect()] == ["b"]
    assert [r["from_relative_path"] for r in incoming.collect()] == ["b", "c"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()))"], capture_output=True, text=True, cwd=__file__.rpartition("/tests/")[0])
    assert done.stdout.strip() == "True", done.stderr


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codeloom.plans.shared import shared_dir

    empty = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        session = SimpleNamespace(conf=empty, sparkContext=SimpleNamespace(master=master, getConf=lambda: empty))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session)


def test_files_are_never_broadcast(spark):
    # their guessed size is far below that of their ids and paths
    from codeloom import entries

    df = entries.queries()["dependencies"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 4
