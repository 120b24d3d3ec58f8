import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import parse


def run(spark, files):
    """files: {path: (language, source)} -> symbols, imports, chunks, warnings by path."""
    rows = [(p, p, language, source) for p, (language, source) in files.items()]
    parsed = parse.parse(spark.createDataFrame(rows, "file_id string, relative_path string, language string, source string"))
    symbols, imports = {p: [] for p in files}, {p: [] for p in files}
    for r in parsed.symbols.orderBy("position").collect():
        symbols[r["file_path"]].append((r["start_line"], r["kind"], r["name"]))
    for r in parsed.imports.orderBy("position").collect():
        imports[r["file_id"]].append((r["line"], r["raw_target"]))
    return symbols, imports, parsed


def one(spark, language, source):
    symbols, imports, _ = run(spark, {"f": (language, source)})
    return symbols["f"], imports["f"]


def test_rust(spark):
    source = "use crate::a::B;\nmod x;\npub struct S {\n}\nenum E {}\npub trait T {}\nimpl S {\n    pub fn m(&self) {\n    }\n}\nfn f() {}\n"
    symbols, imports = one(spark, "rust", source)
    assert symbols == [(2, "Module", "x"), (3, "Struct", "S"), (5, "Enum", "E"), (6, "Trait", "T"), (7, "Type", "S"), (8, "Method", "m"), (11, "Function", "f")]
    assert imports == [(1, "crate::a::B"), (2, "x")]


def test_python(spark):
    symbols, imports = one(spark, "python", "import os, sys  \nfrom a.b import c as d\nclass K:\n    def m(self):\n        pass\nasync def n(): pass\n")
    assert symbols == [(3, "Class", "K"), (4, "Function", "m")]
    assert imports == [(1, "os, sys"), (2, "a.b::c as d")]


def test_scripts(spark):
    source = "import {a} from './b';\nconst fs = require(\"fs\");\nexport function g() {}\nclass C {}\nexport const h = async (x) => x;\nconst t = (a + b);\nimport './c';\nexport default function z() {}\n"
    for language in ("javascript", "typescript"):
        symbols, imports = one(spark, language, source)
        assert symbols == [(3, "Function", "g"), (4, "Class", "C"), (5, "Function", "h"), (6, "Function", "t")]
        assert imports == [(1, "./b"), (2, "fs")]


def test_java(spark):
    source = "import static x.Y;\npublic class A {\n  interface I {}\n  public static int m(int x) {\n    return foo(x);\n    new Foo(1);\n    else if (x) {\n  public final void n() {\n  Map<String, Integer> f() {\n"
    symbols, imports = one(spark, "java", source)
    assert symbols == [(2, "Class", "A"), (3, "Interface", "I"), (4, "Method", "m"), (5, "Method", "foo"), (6, "Method", "Foo"), (7, "Method", "if")]
    assert imports == [(1, "static x.Y")]


def test_go(spark):
    source = 'import "fmt"\n    "os"\nfunc (r *R) M() {}\nfunc F() {}\nfunc G[T any]() {}\ntype S struct {\ntype I interface {\n'
    symbols, imports = one(spark, "go", source)
    assert symbols == [(3, "Method", "M"), (4, "Function", "F"), (6, "Struct", "S"), (7, "Interface", "I")]
    assert imports == [(2, "os")]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("impl Display for User {", "for"), ("impl User where T: X {", "where"), ("impl<T> Foo<T> {", None), ("impl <T> Foo<T> {", "Foo")],
)
def test_impl_headers(spark, line, expected):
    symbols, _ = one(spark, "rust", line + "\nfn f() {}\n")
    assert symbols == ([(1, "Type", expected), (2, "Method", "f")] if expected else [(2, "Function", "f")])


def test_blank_target(spark):
    assert one(spark, "rust", "use  ;\n")[1] == [(1, "")]


def test_sentinel(spark):
    bad = "fn a() {}\n<<parse-error>>\n"
    symbols, _, parsed = run(spark, {"a.rs": ("rust", bad), "b.py": ("python", bad), "c.ts": ("typescript", bad), "d.java": ("java", "class K\n" + bad), "e.go": ("go", "func F() {}\n" + bad), "f": ("unknown", bad), "g.rs": ("rust", None), "h.rs": ("rust", "")})
    assert symbols == {"a.rs": [], "b.py": [], "c.ts": [], "d.java": [(1, "Class", "K"), (2, "Method", "a")], "e.go": [(1, "Function", "F")], "f": [], "g.rs": [], "h.rs": []}
    assert sorted((r["file_path"], r["stage"], r["message"]) for r in parsed.warnings.collect()) == [("a.rs", "parse", "forced rust parser failure"), ("b.py", "parse", "forced python parser failure"), ("c.ts", "parse", "forced js parser failure")]


def test_chunks(spark):
    _, _, parsed = run(spark, {"a.rs": ("rust", "struct S {}\n")})
    chunk, symbol = parsed.chunks.first(), parsed.symbols.first()
    assert (chunk["label"], chunk["symbol_id"], chunk["start_line"], chunk["end_line"]) == ("symbol:S", symbol["symbol_id"], 1, 1)


def simulate(source):
    """The impl state, line by line."""
    inside, depth, out = False, 0, []
    for n, line in enumerate(source.split("\n")[:-1], 1):
        delta = line.count("{") - line.count("}")
        if m := re.match(r"\s*impl(?:\s+[^ ]+)?\s+([A-Za-z_][A-Za-z0-9_]*)", line):
            inside, depth = True, depth + delta
            out.append((n, "Type", m[1]))
            continue
        if m := re.match(r"\s*(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)", line):
            out.append((n, "Method" if inside else "Function", m[1]))
        if inside:
            depth += delta
            if depth <= 0:
                inside, depth = False, 0
    return out


def test_impl_scope_against_a_simulation(spark):
    rng = random.Random(7)
    lines = ["impl A {", "impl B for C {", "impl D {}", "impl E", "fn f() {", "fn g() {}", "pub fn h()", "}", "}}", "{", "x", "where T: {", "} else {", ""]
    files = {f"f{i}.rs": ("rust", "".join(rng.choice(lines) + "\n" for _ in range(rng.randint(0, 25)))) for i in range(200)}
    symbols, _, _ = run(spark, files)
    assert symbols == {p: simulate(s) for p, (_, s) in files.items()}


def test_plan_stays_native(spark):
    files = spark.createDataFrame([("f", "f", "rust", "fn f() {}")], "file_id string, relative_path string, language string, source string")
    plan = parse.parse(files).symbols._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and F is not None
