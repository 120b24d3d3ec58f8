"""Settings of a scan. There is no configuration file: defaults always hold."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from . import schemas
from .functions import ids

#: Languages, the size limit, and folder names that are never entered.
LANGUAGES = ("rust", "python", "javascript", "typescript", "java", "go")


@dataclass(frozen=True)
class Config:
    output_dir: str = ".codeloom"
    max_file_size_bytes: int = 1_048_576
    ignored_dirs: tuple[str, ...] = (".git", ".codeloom", "node_modules", "target", "dist", "build", "vendor")
    enabled_languages: tuple[str, ...] = field(default=LANGUAGES)

    @staticmethod
    def from_path(path: str) -> Config:
        return Config()


@dataclass(frozen=True)
class Context:
    """Identity of what is indexed, and the versions that decide on indexing again."""

    root: str
    repo_id: str
    project_id: str
    worktree_id: str
    scope_id: str
    parser_version: str = schemas.PARSER_VERSION
    schema_version: str = schemas.SCHEMA_VERSION
    chunker_version: str = schemas.CHUNKER_VERSION

    @staticmethod
    def of(root: str, **versions: str) -> Context:
        root = os.path.realpath(root)
        repo = ids.repo_id(root)
        return Context(root, repo, ids.project_id(repo), ids.worktree_id(root), ids.scope_id(root), **versions)
