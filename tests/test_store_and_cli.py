import json
import os

import pytest

from codeloom import cli, schemas
from codeloom.operators.scan import scan_tree
from codeloom.plans.store import GraphStore, SchemaMismatch, without_edges
from tests.trees import SAMPLE, write


def ticking(start=1000):
    now = iter(range(start, start + 1000))
    return lambda: str(next(now))


def ask(engine, *args):
    return list(cli.run(engine, cli.parser().parse_args([args[0], *((args[1],) if args[0] == "graph" else ()), engine.root, *args[2 if args[0] == "graph" else 1 :]])))


def test_whole_life_of_a_tree(spark, tmp_path):
    root = write(tmp_path, SAMPLE)
    engine = cli.Engine(spark, root, ticking())
    assert ask(engine, "status")[:3] == ["tracked_files: 0", "scan_files: 6", "added: 6"]
    assert ask(engine, "index") == [f"indexed {root}/.codeloom (incremental)"]
    assert ask(engine, "status") == ["tracked_files: 6", "scan_files: 6", "added: 0", "modified: 0", "deleted: 0", "unchanged: 6", "skipped: 0", "reindex_needed: 0"]
    assert ask(engine, "impact", "src/glaze/tint.rs") == [
        "file: src/glaze/tint.rs", "impacted: depth=1 src/glaze/mod.rs via src/glaze/tint.rs", "impacted: depth=2 src/furnace.rs via src/glaze/mod.rs",
        "impacted: depth=2 src/glaze/tint.rs via src/glaze/mod.rs", "impacted: depth=2 src/main.rs via src/glaze/mod.rs",
    ]
    assert ask(engine, "impact", "src/main.rs") == ["file: src/main.rs"]
    assert ask(engine, "graph", "neighbors", "src/glaze/mod.rs") == [
        "file: src/glaze/mod.rs", "outgoing: src/glaze/tint.rs via tint", "incoming: src/furnace.rs via crate::glaze::Coat", "incoming: src/glaze/tint.rs via crate::glaze::Coat as Again", "incoming: src/main.rs via glaze",
    ]
    explained = ask(engine, "explain", "src/furnace.rs")
    assert explained[:4] == ["file: src/furnace.rs", "language: rust", "symbol: Module valve", "symbol: Struct Furnace"]
    assert "symbol: Method bake" in explained and "symbol: Function cool" in explained and "import: crate::glaze::Coat line 3" in explained
    assert "imports_file: src/furnace/valve.rs via valve (rust module path resolved to local file)" in explained
    with pytest.raises(cli.NotIndexed, match="file is not indexed: none.rs"):
        ask(engine, "impact", "none.rs")

    with open(os.path.join(engine.exports, "graph.json"), encoding="utf-8") as file:
        exported = json.load(file)
    kinds = [e["kind"] for e in exported["edges"]]
    assert (kinds.count("Defines"), kinds.count("BelongsTo"), kinds.count("Imports"), kinds.count("Calls")) == (16, 16, 11, 0)
    assert [f["language"] for f in exported["files"]] == ["Rust"] * 5 + ["Python"] and exported["warnings"] == []
    shown = ask(engine, "map")[0]
    assert "- rust: 5" in shown and "- python: 1" in shown and "- src/glaze: 2" in shown and "- Furnace (Struct) in src/furnace.rs" in shown and "- File count: 6" in shown and shown.endswith("## Warnings\n- none")
    assert ask(engine, "inspect")[:2] == ["repo-map.md", "# Repo Map"]
    with open(os.path.join(engine.out, "state.json"), encoding="utf-8") as file:
        state = json.load(file)
    assert state["status"] == "completed" and state["stats"]["added"] == 6 and state["stats"]["scanned_files"] == 6

    created = {r["relative_path"]: r["created_at"] for r in engine.store.table("file").collect()}
    os.remove(os.path.join(root, "src/furnace/valve.rs"))
    write(root, {"src/main.rs": "mod furnace;\nmod extra;\n", "src/extra.rs": "<<parse-error>>\n"})
    assert ask(engine, "changed") == ["added\tsrc/extra.rs", "deleted\tsrc/furnace/valve.rs", "modified\tsrc/main.rs"]
    ask(engine, "index")
    files = {r["relative_path"]: r for r in engine.store.table("file").collect()}
    assert files["src/furnace/valve.rs"]["status"] == "deleted" and files["src/furnace/valve.rs"]["deleted_at"]
    assert files["src/main.rs"]["created_at"] == created["src/main.rs"] and files["src/main.rs"]["updated_at"] > created["src/main.rs"]
    assert engine.store.table("symbol").filter("file_path = 'src/furnace/valve.rs'").count() == 0
    assert engine.store.table("symbol").filter("file_path = 'src/furnace.rs'").count() == 6
    assert engine.store.table("warning").count() == 1 and ask(engine, "explain", "src/extra.rs")[-1] == "warning: parse forced rust parser failure"
    assert ask(engine, "impact", "src/furnace.rs") == ["file: src/furnace.rs", "impacted: depth=1 src/main.rs via src/furnace.rs"]
    runs = engine.store.table("index_run").orderBy("started_at").collect()
    assert [(r["status"], r["added"], r["deleted"], r["warnings"]) for r in runs] == [("completed", 6, 0, 0), ("completed", 1, 1, 1)]
    assert engine.store.table("contains_file").count() == 7
    # nothing but what the manifest names is left
    assert engine.store.vacuum() == 0

    write(root, {"src/bad.py": b"\xff"})
    with pytest.raises(Exception, match="not UTF-8"):
        ask(engine, "index")
    assert engine.store.table("index_run").orderBy("started_at").collect()[-1]["status"] == "failed"
    os.remove(os.path.join(root, "src/bad.py"))
    assert ask(engine, "graph", "rebuild") == [f"indexed {root}/.codeloom (full)"]
    assert engine.store.table("index_run").count() == 1 and engine.store.table("file").count() == 6


def test_a_change_writes_only_touched_buckets(spark, tmp_path):
    root = write(tmp_path / "tree", {f"src/f{i}.rs": f"fn a{i}() {{}}\n" for i in range(30)})
    engine = cli.Engine(spark, root, ticking(), store=f"file://{tmp_path}/elsewhere")
    ask(engine, "index")
    before = engine.store._folders("symbol")
    write(root, {"src/f7.rs": "fn b7() {}\nfn c7() {}\n"})
    ask(engine, "index")
    after = engine.store._folders("symbol")
    assert set(before) == set(after) and sum(before[k] != after[k] for k in before) == 1
    assert sorted(r["name"] for r in engine.store.table("symbol").collect()) == sorted([f"a{i}" for i in range(30) if i != 7] + ["b7", "c7"])
    assert os.path.isdir(tmp_path / "elsewhere" / "data") and set(schemas.TABLES) <= set(engine.store.tables())
    assert all(engine.store.table(n).count() >= 0 for n in engine.store.tables())


def test_edges_are_dropped_on_one_or_both_sides(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_file_id string, to_file_id string")
    gone = spark.createDataFrame([("a",)], "file_id string")
    assert sorted(map(tuple, without_edges(edges, gone).collect())) == [("b", "c"), ("c", "a")]
    assert sorted(map(tuple, without_edges(edges, gone, incoming=True).collect())) == [("b", "c")]


def test_versions_and_schema(spark, tmp_path):
    root = write(tmp_path / "tree", SAMPLE)
    scan = scan_tree(spark, root)
    held = GraphStore(spark, f"file://{tmp_path}/store", ticking())
    run = held.begin_index_run(scan.context)
    assert held.table("index_run").first()["status"] == "running"
    held.apply(scan, held.incremental_plan(scan), run)
    assert {r["kind"] for r in held.incremental_plan(scan).collect()} == {"unchanged"}
    before = held.table("symbol").count()
    held.apply(scan, held.incremental_plan(scan), run)
    assert held.table("symbol").count() == before
    newer = scan_tree(spark, root)
    newer.context = type(scan.context)(**{**scan.context.__dict__, "parser_version": "p9"})
    assert {r["kind"] for r in held.incremental_plan(newer).collect()} == {"reindex_needed"}
    assert held.rebuild_scope_import_edges(scan.context) == 6 == held.rebuild_scope_import_edges(scan.context)
    with pytest.raises(KeyError):
        held.complete_index_run("none", {})
    same = GraphStore(spark, f"file://{tmp_path}/store", lambda: "1000")
    with pytest.raises(ValueError, match="same second"):
        same.begin_index_run(scan.context)

    old = schemas.SCHEMA_VERSION
    try:
        schemas.SCHEMA_VERSION = "other"
        with pytest.raises(SchemaMismatch):
            held.init_schema(rebuild=False)
        held.init_schema()
        assert held.stored_schema_version() == "other" and held.table("file").count() == 0
    finally:
        schemas.SCHEMA_VERSION = old


def test_refresh_keeps_the_graph(spark, tmp_path):
    root = write(tmp_path, SAMPLE)
    engine = cli.Engine(spark, root, ticking())
    ask(engine, "index")
    write(root, {"src/furnace.rs": "fn x() {}\n"})
    assert ask(engine, "index", "--refresh")[0].endswith("(refresh)")
    assert ask(engine, "changed") == ["modified\tsrc/furnace.rs"]
