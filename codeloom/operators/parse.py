"""Parse: from source files to symbols, imports, chunks and warnings.

All expressions are built-in: a file's lines are exploded, each line is tested
against its language's rules, and findings are exploded again. The only state
between lines, whether a line lies in an impl block, is one fold over the line
array of a file, kept as a few spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from .rules import DIALECTS, PREFIX, RULES, SENTINEL, Rule


@dataclass
class Parsed:
    """symbols, imports (both with `position`, the order in their file), chunks, warnings."""

    symbols: DataFrame
    imports: DataFrame
    chunks: DataFrame
    warnings: DataFrame


def _matches(rule: Rule, line: Column) -> Column:
    return F.rlike(line, F.lit(PREFIX + rule.pattern))


def brace_delta(line: Column) -> Column:
    n = F.length(line)
    return (n - F.length(F.replace(line, F.lit("{"), F.lit("")))) - (n - F.length(F.replace(line, F.lit("}"), F.lit(""))))


def impl_spans(lines: Column) -> Column:
    """(from, to) line indexes, from 0, that count as inside an impl block.

    A block's own line opens it and moves the depth; any later line counts as
    inside and then moves the depth; the block is left where it falls to zero.
    """
    rule = next(r for r in RULES if r.label == "impl")
    spans = "array<struct<from:int,to:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("open"), F.array().cast(spans).alias("spans"))

    def step(a: Column, line: Column) -> Column:
        moved = a["depth"] + brace_delta(line)
        header = _matches(rule, line)
        leaves = ~header & (a["open"] >= 0) & (moved <= 0)
        inside = header | (a["open"] >= 0)
        span = F.struct(a["open"].alias("from"), a["at"].alias("to"))
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(leaves | ~inside, 0).otherwise(moved).alias("depth"),
            F.when(leaves, -1).when(header & (a["open"] < 0), a["at"] + 1).otherwise(a["open"]).alias("open"),
            F.when(leaves, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
        )

    def end(a: Column) -> Column:
        return F.when(a["open"] >= 0, F.array_append(a["spans"], F.struct(a["open"].alias("from"), a["at"].alias("to")))).otherwise(a["spans"])

    return F.aggregate(lines, begin, step, end)


def _finding(rule: Rule, order: int, line: Column, inside: Column) -> Column:
    parts = [F.regexp_extract(line, PREFIX + rule.pattern, g) for g in rule.groups]
    parts = [text.trim(p) for p in parts] if rule.trimmed else parts
    kind = F.when(inside, rule.kind_inside).otherwise(rule.kind) if rule.kind_inside else F.lit(rule.kind)
    holds = _matches(rule, line)
    if rule.unless:
        other = next(r for r in RULES if r.label == rule.unless and r.language == rule.language)
        holds = holds & ~_matches(other, line)
    if rule.when:
        holds = holds & (F.regexp_extract(line, PREFIX + rule.pattern, rule.when[0]) == rule.when[1])
    return F.when(holds, F.struct(F.lit(order).alias("rule"), kind.alias("kind"), F.concat_ws("::", *parts).alias("text")))


def findings(files: DataFrame) -> DataFrame:
    """files (file_id, relative_path, language, source) -> one row a finding: line, position, kind (empty: import), text."""
    failing = [k for k, (_, name) in DIALECTS.items() if name]
    good = files.filter(F.col("source").isNotNull() & ~(F.col("language").isin(*failing) & F.contains("source", F.lit(SENTINEL))))
    lined = good.select("file_id", "relative_path", "language", text.lines(F.col("source")).alias("lines"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    lined = lined.withColumn("spans", F.when(F.col("language") == "rust", impl_spans(F.col("lines"))).otherwise(none))
    each = lined.select("file_id", "relative_path", "language", "spans", F.posexplode("lines").alias("at", "text_line"))
    inside = F.exists("spans", lambda s: F.col("at").between(s["from"], s["to"]))
    found = F.array().cast("array<struct<rule:int,kind:string,text:string>>")
    for name in dict.fromkeys(d for d, _ in DIALECTS.values()):
        languages = [k for k, (d, _) in DIALECTS.items() if d == name]
        rules = [_finding(r, i, F.col("text_line"), inside) for i, r in enumerate(RULES) if r.language == name]
        found = F.when(F.col("language").isin(*languages), F.array_compact(F.array(*rules))).otherwise(found)
    rows = each.select("file_id", "relative_path", "language", (F.col("at") + 1).alias("line"), F.explode(found).alias("f"))
    return rows.select("file_id", "relative_path", "language", "line", (F.col("line").cast("long") * 4096 + F.col("f.rule")).alias("position"), F.col("f.kind").alias("kind"), F.col("f.text").alias("text"))


def parse(files: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Parsed:
    """files: file_id, relative_path, language, source (text). A null source or unknown language yields nothing.

    `once` may keep the findings, from which symbols, imports and chunks are read.
    """
    rows = once(findings(files))
    line = F.col("line")
    named = rows.filter("kind != ''").withColumn("symbol_id", ids.symbol_id(F.col("relative_path"), F.col("text"), line, line))
    symbols = named.select("symbol_id", "file_id", F.col("relative_path").alias("file_path"), F.col("text").alias("name"), "kind", "language", line.alias("start_line"), line.alias("end_line"), "position")
    imports = rows.filter("kind = ''").select(ids.import_id(F.col("file_id"), F.col("text"), line).alias("import_id"), "file_id", F.col("text").alias("raw_target"), "line", "position")
    chunks = named.select(ids.chunk_id(F.col("file_id"), F.col("text"), line, line).alias("chunk_id"), "file_id", "symbol_id", F.concat(F.lit("symbol:"), F.col("text")).alias("label"), line.alias("start_line"), line.alias("end_line"), "position")
    message = F.lit(None).cast("string")
    for language, (_, name) in DIALECTS.items():
        if name:
            message = F.when(F.col("language") == language, f"forced {name} parser failure").otherwise(message)
    failed = files.filter(F.contains("source", F.lit(SENTINEL))).withColumn("message", message).filter("message IS NOT NULL")
    warnings = failed.select(ids.warning_id(F.col("relative_path"), "parse", F.col("message")).alias("warning_id"), "file_id", F.col("relative_path").alias("file_path"), F.lit("parse").alias("stage"), "message")
    return Parsed(symbols, imports, chunks, warnings)
