"""Exports: graph.json, symbols.json, warnings.json and repo-map.md, and the same as Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import kept
from . import graph, parse
from .scan import Scan, source_text

#: Languages as the JSON files spell them.
SPELLED = {"rust": "Rust", "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "java": "Java", "go": "Go"}
NAMES = {"graph": "graph.json", "symbols": "symbols.json", "warnings": "warnings.json", "map": "repo-map.md"}


class Index:
    """What a scan exports: files, symbols, edges and warnings, from the scan alone."""

    def __init__(self, scan: Scan, indexed_at: str):
        self.scan, self.indexed_at = scan, indexed_at
        files = scan.files.withColumn("source", source_text(F.col("content")))
        self.parsed = parse.parse(files, lambda rows: kept(rows, "findings"))
        self.files = scan.files.drop("content")
        self.edges = graph.export_edges(self.files, self.parsed.symbols, self.parsed.imports)

    def _by_file(self, rows: DataFrame, *more: str) -> DataFrame:
        order = self.files.select("file_id", text.path_order(F.col("relative_path")).alias("o"))
        return rows.join(order, "file_id").orderBy("o", *more).drop("o")

    def symbols(self) -> DataFrame:
        return self._by_file(self.parsed.symbols, "position")

    def warnings(self) -> DataFrame:
        return self._by_file(self.parsed.warnings)

    def sorted_files(self) -> DataFrame:
        return self.files.orderBy(text.path_order(F.col("relative_path")))

    def sorted_edges(self) -> DataFrame:
        return self.edges.orderBy("place").drop("place")


def _spelled(language: str) -> str:
    return SPELLED.get(language, "Unknown")


def _file(r) -> dict:
    return {"repo_id": r["repo_id"], "file_id": r["file_id"], "path": r["path"], "relative_path": r["relative_path"], "language": _spelled(r["language"]), "fingerprint": {"sha256": r["sha256"], "size_bytes": r["size_bytes"], "mtime_seconds": r["mtime_seconds"]}}


def _symbol(r) -> dict:
    return {"symbol_id": r["symbol_id"], "file_id": r["file_id"], "file_path": r["file_path"], "name": r["name"], "kind": r["kind"], "range": {"start_line": r["start_line"], "end_line": r["end_line"]}, "language": _spelled(r["language"])}


def _edge(r) -> dict:
    return {"edge_id": r["edge_id"], "from_id": r["from_id"], "to_id": r["to_id"], "kind": r["kind"], "confidence": r["confidence"].asDict(), "evidence": r["evidence"].asDict()}


def _warning(r) -> dict:
    return {"warning_id": r["warning_id"], "file_id": r["file_id"], "file_path": r["file_path"], "stage": r["stage"], "message": r["message"]}


def _items(rows: DataFrame, to_dict, indent: str) -> Iterator[str]:
    """A JSON list, a row at a time."""
    empty = True
    for r in rows.toLocalIterator():
        yield ("[\n" if empty else ",\n") + "\n".join(f"{indent}  {line}" for line in json.dumps(to_dict(r), indent=2, ensure_ascii=False).split("\n"))
        empty = False
    yield "[]" if empty else f"\n{indent}]"


def render_map(index: Index, root: str) -> Iterator[str]:
    n = index.files.count()
    yield f"# Repo Map\n\n- Repo path: {root}\n- Indexed at: {index.indexed_at}\n- File count: {n}\n\n## Language summary\n"
    yield "\n".join(f"- {r['language']}: {r['files']}" for r in graph.language_summary(index.files).toLocalIterator())
    yield "\n\n## Directory summary\n"
    yield "\n".join(f"- {r['directory']}: {r['files']}" for r in graph.directory_summary(index.files).toLocalIterator())
    yield "\n\n## Symbol summary\n"
    yield from _lines(f"- {r['name']} ({r['kind']}) in {r['file_path']}" for r in index.symbols().toLocalIterator())
    yield "\n\n## Imports summary\n"
    yield from _lines((f"- {r['detail']}: {r['imports']}" for r in graph.imports_summary(index.edges).toLocalIterator()), "- none")
    yield "\n\n## Warnings\n"
    yield from _lines((f"- {r['file_path']} [{r['stage']}] {r['message']}" for r in index.warnings().toLocalIterator()), "- none")
    yield "\n"


def _lines(rows: Iterator[str], none: str = "") -> Iterator[str]:
    first = True
    for row in rows:
        yield row if first else "\n" + row
        first = False
    if first:
        yield none


def _put(path: str, parts: Iterator[str]) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as file:
        file.writelines(parts)
    os.replace(path + ".tmp", path)


def export(index: Index, folder: str) -> dict[str, str]:
    """Writes the four files and returns their paths. Rows stream to the driver; none is held."""
    os.makedirs(folder, exist_ok=True)
    paths = {k: os.path.join(folder, name) for k, name in NAMES.items()}
    head = {"repo_id": index.scan.context.repo_id, "repo_root": index.scan.context.root, "indexed_at": index.indexed_at}

    def whole() -> Iterator[str]:
        yield "{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in head.items())
        parts = (("files", index.sorted_files(), _file), ("symbols", index.symbols(), _symbol), ("edges", index.sorted_edges(), _edge), ("warnings", index.warnings(), _warning))
        for i, (name, rows, to_dict) in enumerate(parts):
            yield f'  "{name}": '
            yield from _items(rows, to_dict, "  ")
            yield "\n" if i == len(parts) - 1 else ",\n"
        yield "}"

    _put(paths["graph"], whole())
    _put(paths["symbols"], _items(index.symbols(), _symbol, ""))
    _put(paths["warnings"], _items(index.warnings(), _warning, ""))
    _put(paths["map"], render_map(index, index.scan.context.root))
    return paths


def export_parquet(index: Index, folder: str) -> None:
    """The same tables for use at scale: files, symbols, edges and warnings, unsorted."""
    for name, rows in (("files", index.files), ("symbols", index.parsed.symbols), ("edges", index.edges.drop("place")), ("warnings", index.parsed.warnings)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(folder: str, name: str):
    """An exported file, read back: parsed JSON, or the map's text."""
    with open(os.path.join(folder, NAMES[name]), encoding="utf-8") as file:
        return file.read() if name == "map" else json.load(file)
