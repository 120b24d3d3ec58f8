"""Commands over a source tree: python -m codeloom.cli COMMAND PATH ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from pyspark.sql import SparkSession

from .config import Config, Context
from .operators import change, export
from .operators.scan import scan_tree
from .plans.store import GraphStore, Store, epoch_seconds


class NotIndexed(Exception):
    pass


class Engine:
    """A source tree, its store and its exports."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], str] = epoch_seconds, store: str | None = None):
        """`store`: where the graph is kept, on any file system that Spark reaches; by default beside the tree."""
        self.spark, self.root, self.config, self.clock = spark, os.path.realpath(root), Config.from_path(root), clock
        self.context = Context.of(self.root)
        self.out = os.path.join(self.root, self.config.output_dir)
        self.store: Store = GraphStore(spark, store or f"file://{self.out}/store", clock)
        self.exports = os.path.join(self.out, "exports")

    def _stats(self, plan, scanned: int) -> dict[str, int]:
        return change.plan_stats(plan).first().asDict() | {"scanned_files": scanned}

    def index(self, full: bool = False, refresh: bool = False) -> str:
        """Scan, plan, parse, store, resolve, export. `full` begins anew; `refresh` only records the run and exports."""
        scan = scan_tree(self.spark, self.root, self.config)
        scan.files = scan.files.cache()
        try:
            if full:
                self.store.reset()
            run = self.store.begin_index_run(self.context)
            plan = self.store.incremental_plan(scan).cache()
            stats = self._stats(plan, scan.files.count())
            try:
                if not refresh:
                    stats["warnings"] = self.store.apply(scan, plan, run)
            except Exception as error:
                self.store.fail_index_run(run, str(error))
                self._state(run, "failed", stats)
                raise
            if not refresh:
                self.store.rebuild_scope_import_edges(self.context)
            self.store.complete_index_run(run, stats)
            self._state(run, "completed", stats)
            export.export(export.Index(scan, self.clock()), self.exports)
            plan.unpersist()
            self.store.vacuum()
        finally:
            scan.files.unpersist()
        return f"indexed {self.out} ({'full' if full else 'refresh' if refresh else 'incremental'})"

    def _state(self, run: str, status: str, stats: dict[str, int]) -> None:
        os.makedirs(self.out, exist_ok=True)
        with open(os.path.join(self.out, "config.toml"), "w", encoding="utf-8") as file:
            file.write(f'output_dir = "{self.config.output_dir}"\nmax_file_size_bytes = {self.config.max_file_size_bytes}\n')
        with open(os.path.join(self.out, "state.json"), "w", encoding="utf-8") as file:
            json.dump({"run_id": run, "status": status, "stats": stats}, file, indent=2)

    def _scan(self):
        self.store.init_schema(rebuild=False)
        return scan_tree(self.spark, self.root, self.config)

    def status(self) -> list[str]:
        return [f"{k}: {v}" for k, v in self.store.repo_status(self._scan()).items()]

    def changed(self) -> Iterator[str]:
        return (f"{r['kind']}\t{r['relative_path']}" for r in self.store.changed_files(self._scan()).toLocalIterator())

    def _found(self, found, file: str):
        if found is None:
            raise NotIndexed(f"file is not indexed: {file}")
        return found

    def explain(self, file: str) -> list[str]:
        self.store.init_schema(rebuild=False)
        parts = {k: v.collect() for k, v in self._found(self.store.explain(self.context.scope_id, file), file).items()}
        out = [f"file: {parts['file'][0]['relative_path']}", f"language: {parts['file'][0]['language']}"]
        out += [f"symbol: {r['kind']} {r['name']}" for r in parts["symbols"]]
        out += [f"import: {r['raw_target']} line {r['line']}" for r in parts["imports"]]
        out += [f"imports_file: {r['to_relative_path']} via {r['raw_target']} ({r['evidence']})" for r in parts["dependencies"]]
        return out + [f"warning: {r['stage']} {r['message']}" for r in parts["warnings"]]

    def neighbors(self, file: str) -> list[str]:
        self.store.init_schema(rebuild=False)
        outgoing, incoming = self._found(self.store.neighbors(self.context.scope_id, file), file)
        out = [f"file: {file}"] + [f"outgoing: {r['to_relative_path']} via {r['raw_target']}" for r in outgoing.collect()]
        return out + [f"incoming: {r['from_relative_path']} via {r['raw_target']}" for r in incoming.collect()]

    def impact(self, file: str) -> Iterator[str]:
        self.store.init_schema(rebuild=False)
        rows = self._found(self.store.impact(self.context.scope_id, file), file).toLocalIterator()
        return chain([f"file: {file}"], (f"impacted: depth={r['depth']} {r['relative_path']} via {r['via_relative_path']}" for r in rows))

    def map(self) -> list[str]:
        return [export.load(self.exports, "map").rstrip("\n")]

    def inspect(self) -> list[str]:
        first = next((x for x in export.load(self.exports, "map").splitlines() if x.strip()), "")
        sizes = [f"{export.NAMES[n]} bytes: {os.path.getsize(os.path.join(self.exports, export.NAMES[n]))}" for n in ("graph", "symbols", "warnings")]
        return [export.NAMES["map"], first or "empty", *sizes]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeloom")
    out.add_argument("--store", help="folder of the graph, as a path or URI that all executors reach")
    commands = out.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path")
    index.add_argument("--full", action="store_true")
    index.add_argument("--refresh", action="store_true")
    for name in ("status", "changed", "map", "inspect"):
        commands.add_parser(name).add_argument("path")
    for name in ("explain", "impact"):
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("file")
    inner = commands.add_parser("graph").add_subparsers(dest="inner", required=True)
    near = inner.add_parser("neighbors")
    near.add_argument("path")
    near.add_argument("file")
    inner.add_parser("rebuild").add_argument("path")
    return out


def run(engine: Engine, args: argparse.Namespace) -> Iterable[str]:
    """Lines to print."""
    if args.command == "index":
        return [engine.index(args.full, args.refresh)]
    if args.command == "graph":
        return engine.neighbors(args.file) if args.inner == "neighbors" else [engine.index(full=True)]
    call = getattr(engine, args.command)
    return call(args.file) if "file" in args else call()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for line in run(Engine(spark, args.path, store=args.store), args):
            print(line)
    except NotIndexed as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
