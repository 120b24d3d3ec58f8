"""Ignore files, as git understands them.

Honoured: `.ignore` anywhere, also of all parent folders; `.gitignore` (also of
parent folders up to the repository's top), `.git/info/exclude` and the user's
global file (`core.excludesFile`) inside a git repository. The last matching line of the nearest file decides; `!` takes back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass


def pattern_to_regex(pattern: str) -> str:
    """A glob of an ignore file, without marks for negation and folders, as an expression for a whole path."""
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out, i = out + ".+", n
        elif c == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
        elif c == "\\" and i + 1 < n:
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Line:
    expression: re.Pattern[str]
    keeps: bool
    folders_only: bool


def parse_lines(text: str) -> list[Line]:
    found = []
    for raw in text.splitlines():
        line = raw.rstrip("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[keeps:]
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        anchored = "/" in line
        body = pattern_to_regex(line.lstrip("/"))
        if body:
            found.append(Line(re.compile((body if anchored else "(?:.*/)?" + body) + r"\Z", re.DOTALL), keeps, folders))
    return found


class Rules:
    """Lines of one file, for paths relative to its folder."""

    def __init__(self, folder: str, path: str):
        self.folder, self.lines = folder, []
        try:
            with open(path, encoding="utf-8", errors="replace") as file:
                self.lines = parse_lines(file.read())
        except OSError:
            pass

    def says(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored, False: kept, None: nothing."""
        inner = os.path.relpath(path, self.folder).replace(os.sep, "/")
        for line in reversed(self.lines):
            if (is_folder or not line.folders_only) and line.expression.match(inner):
                return not line.keeps
        return None


def git_top(folder: str) -> str | None:
    while True:
        if os.path.exists(os.path.join(folder, ".git")):
            return folder
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def global_file() -> str:
    """The user's excludes file: as named in git's configuration, or else its usual place."""
    home = os.path.expanduser("~")
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for config in (os.path.join(home, ".gitconfig"), os.path.join(base, "git", "config")):
        section = ""
        try:
            with open(config, encoding="utf-8", errors="replace") as file:
                lines = [x.strip() for x in file]
        except OSError:
            continue
        for line in lines:
            key, equals, value = line.partition("=")
            if line.startswith("["):
                section = line.strip("[]").strip().lower()
            elif section == "core" and equals and key.strip().lower() == "excludesfile":
                return os.path.expanduser(value.strip().strip('"'))
    return os.path.join(base, "git", "ignore")


def walk(root: str, skip_names: frozenset[str] = frozenset()) -> Iterator[os.DirEntry]:
    """Regular files under root that no ignore file names, hidden ones included; links are not followed."""
    top = git_top(root)
    above: list[str] = []
    folder = root
    while top and folder != top:
        folder = os.path.dirname(folder)
        above.insert(0, folder)
    git = [Rules(f, os.path.join(f, ".gitignore")) for f in above] if top else []
    rest = [Rules(top, os.path.join(top, ".git", "info", "exclude")), Rules(top, global_file())] if top else []
    plain: list[Rules] = []
    folder = root
    while os.path.dirname(folder) != folder:
        folder = os.path.dirname(folder)
        plain.insert(0, Rules(folder, os.path.join(folder, ".ignore")))

    def ignored(path: str, is_folder: bool, plain: list[Rules], git: list[Rules]) -> bool:
        for rules in (*reversed(plain), *reversed(git), *rest):
            if (found := rules.says(path, is_folder)) is not None:
                return found
        return False

    def visit(folder: str, plain: list[Rules], git: list[Rules]) -> Iterator[os.DirEntry]:
        plain = [*plain, Rules(folder, os.path.join(folder, ".ignore"))]
        git = [*git, Rules(folder, os.path.join(folder, ".gitignore"))] if top else git
        with os.scandir(folder) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for e in found:
            is_folder = e.is_dir(follow_symlinks=False)
            if e.name in skip_names or ignored(e.path, is_folder, plain, git):
                continue
            if is_folder:
                yield from visit(e.path, plain, git)
            elif e.is_file(follow_symlinks=False):
                yield e

    yield from visit(root, plain, git)
