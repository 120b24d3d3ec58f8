"""Parsing rules as data: what a line of each language declares or imports.

Every pattern is matched at the beginning of a line, after white space. Rules of
a language stand in the order in which their findings are listed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

#: Unicode classes, and only \n ends a line.
PREFIX = r"(?Ud)^\s*"
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
PLAIN_NAME = "[A-Za-z_][A-Za-z0-9_]*"


@dataclass(frozen=True)
class Rule:
    """kind: of the symbol; empty for an import. text: groups that make the name or target, joined by `::`."""

    language: str
    pattern: str
    kind: str = ""
    trimmed: bool = False
    groups: tuple[int, ...] = (1,)
    #: the rule only holds on lines where the one of this label doesn't match
    label: str = ""
    unless: str = ""
    #: kind inside an impl block, if another
    kind_inside: str = ""
    #: and only if this group has this value
    when: tuple[int, str] | None = None


#: Fixed patterns. register() adds to them.
RULES = [
    Rule("rust", r"use\s+([^;]+);", trimmed=True),
    Rule("rust", r"mod\s+" + NAME + r"\s*;", trimmed=True),
    Rule("rust", r"mod\s+" + NAME + r"\s*;", "Module"),
    Rule("rust", r"(?:pub\s+)?struct\s+" + NAME, "Struct"),
    Rule("rust", r"(?:pub\s+)?enum\s+" + NAME, "Enum"),
    Rule("rust", r"(?:pub\s+)?trait\s+" + NAME, "Trait"),
    Rule("rust", r"impl(?:\s+[^ ]+)?\s+" + NAME, "Type", label="impl"),
    Rule("rust", r"(?:pub\s+)?fn\s+" + NAME, "Function", unless="impl", kind_inside="Method"),
    Rule("python", r"import\s+(.+)\z", trimmed=True),
    Rule("python", r"from\s+(.+)\s+import\s+(.+)\z", trimmed=True, groups=(1, 2)),
    Rule("python", r"class\s+" + NAME, "Class"),
    Rule("python", r"def\s+" + NAME, "Function"),
    Rule("script", r"""import\s+.*?from\s+["']([^"']+)["']"""),
    Rule("script", r"(?:const|let|var)\s+" + PLAIN_NAME + r"""\s*=\s*require\(["']([^"']+)["']\)"""),
    Rule("script", r"(?:export\s+)?function\s+" + NAME, "Function"),
    Rule("script", r"(?:export\s+)?class\s+" + NAME, "Class"),
    Rule("script", r"(?:export\s+)?const\s+" + NAME + r"\s*=\s*(?:async\s+)?\(", "Function"),
    Rule("java", r"import\s+([^;]+);", trimmed=True),
    Rule("java", r"(?:public\s+)?class\s+" + NAME, "Class"),
    Rule("java", r"(?:public\s+)?interface\s+" + NAME, "Interface"),
    Rule("java", r"(?:public|private|protected)?\s*(?:static\s+)?[A-Za-z0-9_<>\[\]]+\s+" + NAME + r"\s*\(", "Method"),
    Rule("go", r'"([^"]+)"'),
    Rule("go", r"func\s+\([^)]+\)\s+" + NAME + r"\s*\(", "Method", label="method"),
    Rule("go", r"func\s+" + NAME + r"\s*\(", "Function", unless="method"),
    Rule("go", r"type\s+" + NAME + r"\s+(struct|interface)", "Struct", when=(2, "struct")),
    Rule("go", r"type\s+" + NAME + r"\s+(struct|interface)", "Interface", when=(2, "interface")),
]
#: Rule set of each language, and the name in its forced failure (none: it can't fail).
DIALECTS = {"rust": ("rust", "rust"), "python": ("python", "python"), "javascript": ("script", "js"), "typescript": ("script", "js"), "java": ("java", None), "go": ("go", None)}
#: A text that holds this fails to parse, where the dialect can fail.
SENTINEL = "<<parse-error>>"


def register(language: str, rules: Iterable[Rule], fails_as: str | None = None) -> None:
    """Adds a language, or replaces its rules. `fails_as`: its name in the message of a forced failure, if it can fail.

    Its files must be told by an extension (scan.EXTENSIONS) and enabled (Config.enabled_languages).
    """
    rules = [replace(r, language=language) for r in rules]
    RULES[:] = [r for r in RULES if r.language != language] + rules
    DIALECTS[language] = (language, fails_as)
