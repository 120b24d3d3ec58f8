"""Lines, white space and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    r"""Lines of a text: an end of line is \n or \r\n, and no empty line follows the last one."""
    parts = F.split(text, r"\r?\n", -1)
    whole = F.when((text == "") | F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(whole)


def trim(text: Column) -> Column:
    """Without white space, by Unicode, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def path_key(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_order(path: Column) -> Column:
    """Sort key that orders paths by their components."""
    return F.split(path, "/", -1)


def parent(path: Column) -> Column:
    """All before the last component; empty at the root."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name; null if there is none, or if the name only begins with one."""
    name = base_name(path)
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1)
    return F.when(F.rlike(name, F.lit(r"(?s)^.+\.[^.]*\z")), found)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.rlike(name, F.lit(r"(?s)^.+\.[^.]*\z")), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)).otherwise(name)


def join_path(folder: Column, *rest: Column | str) -> Column:
    tail = F.concat(*[F.lit(r) if isinstance(r, str) else r for r in rest])
    return F.when(folder == "", tail).otherwise(F.concat(folder, F.lit("/"), tail))
