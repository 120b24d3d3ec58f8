"""Stable identifiers as column expressions.

An id is the lower-case hexadecimal SHA-256 of its parts, each followed by one
NUL character. A null part makes a null id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str


def stable_hash(*parts: Part) -> Column:
    """Parts: columns, or strings taken as literals."""
    pieces = []
    for p in parts:
        pieces += [F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("\0")]
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def stable_hash_text(*parts: str) -> str:
    """The same for values on the driver."""
    return hashlib.sha256("".join(p + "\0" for p in parts).encode()).hexdigest()


def repo_id(root: str) -> str:
    return stable_hash_text(root)


def project_id(repo: str) -> str:
    return stable_hash_text(repo, "project")


def worktree_id(root: str) -> str:
    return stable_hash_text(root, "worktree")


def scope_id(root: str) -> str:
    return stable_hash_text(root, "scope")


def run_id(scope: str, started_at: str) -> str:
    return stable_hash_text(scope, started_at, "index-run")


def file_id(project: Part, scope: Part, path: Column) -> Column:
    return stable_hash(project, scope, path)


def skipped_file_id(path: Column) -> Column:
    return stable_hash(path)


def symbol_id(path: Column, name: Column, start: Column, end: Column) -> Column:
    return stable_hash(path, name, start, end)


def import_id(file: Column, target: Column, line: Column) -> Column:
    return stable_hash(file, target, line)


def chunk_id(file: Column, name: Column, start: Column, end: Column) -> Column:
    return stable_hash(file, name, start, end)


def warning_id(path: Column, stage: Part, message: Column) -> Column:
    return stable_hash(path, stage, message)


def import_target_id(target: Column) -> Column:
    return stable_hash(target)


def edge_id(start: Column, end: Column, kind: Part, detail: Column) -> Column:
    """kind in snake case: defines, belongs_to, imports, calls."""
    return stable_hash(start, end, kind, detail)
