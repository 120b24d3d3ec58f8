import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.config import Config, Context
from codeloom.functions import text
from codeloom.operators import scan
from codeloom.sources import ignore
from tests.trees import SAMPLE, SOURCES, write


def paths(df):
    return sorted(r["relative_path"] for r in df.select("relative_path").collect())


def test_defaults():
    config = Config.from_path("/anywhere")
    assert config == Config()
    assert config.max_file_size_bytes == 1_048_576
    assert "rust" in config.enabled_languages and "target" in config.ignored_dirs


def test_sample(spark, tmp_path):
    found = scan.scan_tree(spark, write(tmp_path, SAMPLE))
    assert paths(found.files) == SOURCES
    assert found.skipped.count() == 0
    row = found.files.first()
    assert len(row["sha256"]) == 64 and row["repo_id"] == Context.of(str(tmp_path)).repo_id and row["size_bytes"] > 0


def test_ignored_dirs_are_silent(spark, tmp_path):
    found = scan.scan_tree(spark, write(tmp_path, {"src/lib.rs": "x", "target/a.rs": "x", "node_modules/a.js": "x", "src/build": "x"}))
    assert paths(found.files) == ["src/lib.rs"] and found.skipped.count() == 0


def test_hidden_files_are_found(spark, tmp_path):
    found = scan.scan_tree(spark, write(tmp_path, {"a/__init__.py": "", "_b.py": "", ".github/c.py": "", ".d.py": ""}))
    assert paths(found.files) == [".d.py", ".github/c.py", "_b.py", "a/__init__.py"]


def test_filter_order(spark, tmp_path):
    files = {"big.md": b"x" * 50, "big.rs": b"x" * 41, "fits.rs": b"x" * 40, "bin.md": b"a\0b", "late.rs": b"x" * 39, "note.md": b"hi", "A.RS": b"x"}
    found = scan.scan_tree(spark, write(tmp_path, files), Config(max_file_size_bytes=40))
    assert paths(found.files) == ["fits.rs", "late.rs"]
    assert sorted(map(tuple, found.skipped.collect())) == [("big.md", "oversized"), ("big.rs", "oversized"), ("bin.md", "binary")]


def test_binary_only_in_the_first_bytes(spark, tmp_path):
    found = scan.scan_tree(spark, write(tmp_path, {"a.py": b"x" * 1023 + b"\0", "b.py": b"x" * 1024 + b"\0"}))
    assert paths(found.files) == ["b.py"]


def test_not_utf8_is_an_error(spark, tmp_path):
    found = scan.scan_tree(spark, write(tmp_path, {"a.py": b"\xff\xfe"}))
    with pytest.raises(Exception, match="not UTF-8"):
        found.files.select(scan.source_text(F.col("content"))).collect()


def test_empty_tree_and_no_tree(spark, tmp_path):
    assert scan.scan_tree(spark, str(tmp_path)).files.count() == 0
    with pytest.raises(FileNotFoundError):
        scan.scan_tree(spark, str(tmp_path / "none"))


def test_links_are_not_followed(spark, tmp_path):
    write(tmp_path, {"a.py": "x"})
    os.symlink(tmp_path / "a.py", tmp_path / "b.py")
    assert paths(scan.scan_tree(spark, str(tmp_path)).files) == ["a.py"]


@pytest.mark.parametrize(
    ("lines", "path", "folder", "expected"),
    [
        ("*.log", "a/b.log", False, True), ("/a.txt", "x/a.txt", False, None), ("/a.txt", "a.txt", False, True), ("doc/", "doc", False, None), ("doc/", "x/doc", True, True),
        ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("**/k", "q/k", False, True), ("x/**", "x/y", False, True), ("x/**", "x", True, None),
        ("*.py\n!keep.py", "keep.py", False, False), ("# note\n\\#x", "#x", False, True), ("[ab].c", "a.c", False, True), ("[!ab].c", "a.c", False, None), ("a?c", "abc", False, True), ("a*c", "a/c", False, None),
        ("q  ", "q", False, True), ("a.c", "abc", False, None),
    ],
)
def test_ignore_lines(tmp_path, lines, path, folder, expected):
    (tmp_path / "rules").write_text(lines)
    rules = ignore.Rules(str(tmp_path), str(tmp_path / "rules"))
    assert rules.says(str(tmp_path / path), folder) == expected


def test_gitignore_holds_in_repositories_only(spark, tmp_path):
    files = {".gitignore": "*.py\n!keep.py\nout/\n", "a.py": "", "keep.py": "", "out/x.rs": "", "sub/.gitignore": "!b.py\n", "sub/b.py": "", ".ignore": "n.go\n", "n.go": ""}
    write(tmp_path, files)
    assert paths(scan.scan_tree(spark, str(tmp_path)).files) == ["a.py", "keep.py", "out/x.rs", "sub/b.py"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert paths(scan.scan_tree(spark, str(tmp_path)).files) == ["keep.py", "sub/b.py"]
    assert paths(scan.scan_tree(spark, str(tmp_path / "sub")).files) == ["b.py"]


def test_ignore_files_of_parents_and_of_the_user(spark, tmp_path, monkeypatch):
    root = tmp_path / "out" / "tree"
    write(tmp_path, {"out/.ignore": "n.go\n/tree/deep/\n", "out/tree/n.go": "", "out/tree/deep/a.go": "", "out/tree/b.go": "", "out/tree/c.py": "", "home/.gitconfig": "[user]\n\tname = x\n[core]\n\texcludesFile = ~/mine\n", "home/mine": "*.py\n"})
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    assert sorted(os.path.relpath(e.path, root) for e in ignore.walk(str(root))) == ["b.go", "c.py"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    assert sorted(p for p in (os.path.relpath(e.path, root) for e in ignore.walk(str(root))) if not p.startswith(".git")) == ["b.go"]


def test_a_registered_language(spark, tmp_path):
    from codeloom.config import LANGUAGES
    from codeloom.operators import parse, rules

    before, known = list(rules.RULES), dict(rules.DIALECTS)
    rules.register("ruby", [rules.Rule("", r"require\s+'([^']+)'"), rules.Rule("", r"def\s+" + rules.NAME, "Method")], "ruby")
    scan.EXTENSIONS["rb"] = "ruby"
    try:
        tree = write(tmp_path, {"a.rb": "require 'set'\ndef run\nend\n", "b.rb": "<<parse-error>>", "c.py": "def f(): pass\n"})
        found = scan.scan_tree(spark, tree, Config(enabled_languages=(*LANGUAGES, "ruby")))
        parsed = parse.parse(found.files.withColumn("source", scan.source_text(F.col("content"))))
        assert sorted((r["file_path"], r["kind"], r["name"]) for r in parsed.symbols.collect()) == [("a.rb", "Method", "run"), ("c.py", "Function", "f")]
        assert [r["raw_target"] for r in parsed.imports.collect()] == ["set"]
        assert [r["message"] for r in parsed.warnings.collect()] == ["forced ruby parser failure"]
    finally:
        rules.RULES[:] = before
        rules.DIALECTS.clear()
        rules.DIALECTS.update(known)
        del scan.EXTENSIONS["rb"]


def test_languages(spark):
    cases = {"a.rs": "rust", "a.py": "python", "a.jsx": "javascript", "a.js": "javascript", "b/a.tsx": "typescript", "a.ts": "typescript", "a.java": "java", "a.go": "go", "a.RS": "unknown", ".rs": "unknown", "rs": "unknown", "a.rs/b": "unknown", "a.b.rs": "rust"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", scan.language(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == cases


def test_lines(spark):
    cases = {"": [], "a\n": ["a"], "a\n\n": ["a", ""], "a\r\nb\r": ["a", "b\r"], "a\r\r\nb": ["a\r", "b"], "a": ["a"], "\n": [""]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.lines(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["l"] for r in rows} == cases


def test_path_order(spark):
    rows = spark.createDataFrame([("a.rs",), ("a/b.rs",), ("a-b/c.rs",), ("B.rs",)], "p string").orderBy(text.path_order(F.col("p"))).collect()
    assert [r["p"] for r in rows] == ["B.rs", "a/b.rs", "a-b/c.rs", "a.rs"]
