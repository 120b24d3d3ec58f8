r"""Operator 8: secret scans by one combined deterministic automaton.

All rules are compiled into one minimal automaton with search (automaton.py).
Texts are cut into segments at bytes after which no rule can go on (found from
the transition array itself), and all segments of a batch run in step: one
numpy gather a byte position moves every segment's state, for all rules at once.
Where no such byte comes for long, pieces are cut anywhere and states handed on.
Where a state accepts, the rule's own automaton finds leftmost longest spans, and
the rule's condition (lengths) is checked on the span's characters.

Defined results: null and empty texts have no spans. Spans of one kind never
overlap, those of different kinds may. Offsets are code points, end exclusive.
Other columns are carried; the operator's own is `secret_spans`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton, compile_rules
from .shared import table
from .words import pieces, tidy, utf8


@dataclass(frozen=True)
class Rule:
    """pattern: what the span is. group, least: group `group` has `least` characters or more, else the match is dropped."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 1
    #: for the scan, if it can be narrower than the pattern without missing a span that passes
    scan: str = ""


#: Fixed base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24, scan=r"[0-9a-f]{24}[0-9a-f]*"),
)
#: Well-known formats of other issuers' keys, which the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Bytes of a segment, about; bytes of text that run in step.
SEGMENT, CHUNK = 384, 1 << 21


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.machine = compile_rules([(r.scan or r.pattern, r.either_case) for r in rules], search=True)
        self.own = [compile_rules([(r.pattern, r.either_case)], search=False) for r in rules]
        self.check = [re.compile(r.pattern, re.IGNORECASE * r.either_case | re.ASCII) for r in rules]
        self.reset, self.first = self.machine.resets(), [m.first_bytes() for m in self.own]

    def accepts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (exclusive) of matches, and the rules that match there: one pass over the bytes.

        Pieces begin after a reset byte, or, where none comes for long, anywhere: such a
        piece runs from the start state first, and once more from the state in which the
        piece before it has ended, if that is another. A state that is not known yet is
        taken to last through the pieces that follow, so that they run in step too.
        """
        m: Automaton = self.machine
        cut = np.flatnonzero(self.reset[data]) + 1
        step = np.searchsorted(cut, np.arange(SEGMENT, len(data), SEGMENT))
        starts = np.unique(np.concatenate(([0], cut[step[step < len(cut)]])))
        starts = starts[starts < len(data)]
        sizes = np.diff(np.append(starts, len(data)))
        # long segments fall into pieces; `after` says that one goes on with what came before
        parts = np.maximum(1, -(-sizes // (2 * SEGMENT)))
        first = np.cumsum(parts) - parts
        place = np.arange(int(parts.sum())) - np.repeat(first, parts)
        starts = np.repeat(starts, parts) + place * (2 * SEGMENT)
        sizes = np.minimum(np.repeat(sizes, parts) - place * (2 * SEGMENT), 2 * SEGMENT)
        after = np.flatnonzero(place > 0)
        start = m.start * m.n_classes
        classes = m.byte_class[data].astype(np.int32)
        ended, ends, rules = self._run(classes, starts, sizes, np.full(len(starts), start, np.int32))
        if not len(after):
            return ends, rules
        # by piece: where it ends from an entry state, and which run that was
        known: dict[tuple[int, int], tuple[int, int]] = {}
        runs = [(ends, rules, np.searchsorted(starts, ends, "left") - 1)]
        entry: dict[int, tuple[int, int]] = {}
        while True:
            todo, state = [], start
            entry.clear()
            for i in after.tolist():
                state = ended[i - 1] if place[i] == 1 else state
                at = (int(ended[i]), 0) if state == start else known.get((i, int(state)))
                if at is None:
                    todo.append((i, int(state)))
                else:
                    entry[i], state = (int(state), at[1]), at[0]
            if not todo:
                break
            which, states = np.array([t[0] for t in todo]), np.array([t[1] for t in todo], np.int32)
            later, more, of = self._run(classes, starts[which], sizes[which], states)
            for (i, state), end in zip(todo, later.tolist(), strict=True):
                known[i, state] = end, len(runs)
            runs.append((more, of, np.searchsorted(starts, more, "left") - 1))
        right = np.zeros(len(starts), np.int64)
        for i, (_, run) in entry.items():
            right[i] = run
        kept = [right[piece] == r for r, (_, _, piece) in enumerate(runs)]
        return np.concatenate([e[k] for (e, _, _), k in zip(runs, kept, strict=True)]), np.concatenate([r[k] for (_, r, _), k in zip(runs, kept, strict=True)])

    def _run(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in step: the state in which each ends; ends and rules of matches."""
        m: Automaton = self.machine
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, state = starts[order], sizes[order], states[order]
        width, moves, least = m.n_classes, m.next * m.n_classes, m.first_accept * m.n_classes
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left") if len(sizes) else np.empty(0, int)
        ends, rules = [np.empty(0, int)], [np.empty(0, int)]
        for t, n in enumerate(active.tolist()):
            now = moves[state[:n] + classes[starts[:n] + t]]
            state[:n] = now
            if now.max() >= least:
                hit = np.flatnonzero(now >= least)
                ends.append(starts[hit] + t + 1)
                rules.append(m.rules[now[hit] // width])
        ended = np.empty_like(state)
        ended[order] = state
        return ended, np.concatenate(ends), np.concatenate(rules)

    def spans(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points of each text, by start, then by rule."""
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        first = np.concatenate(([0], np.cumsum(sizes)))
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        ends, rules = self.accepts(np.frombuffer(joined, np.uint8))
        if not len(ends):
            return out
        owner = np.searchsorted(first, ends - 1, "right") - 1
        for k, rule in enumerate(self.rules):
            here = np.flatnonzero(rules >> k & 1)
            for d in np.unique(owner[here]).tolist():
                text, low = texts[d] or b"", int(first[d])
                events = np.sort(ends[here[owner[here] == d]]) - low
                out[d] += [(rule.kind, a, b, k) for a, b in self._resolve(k, text, events.tolist())]
        for d, found in enumerate(out):
            if found:
                text = np.frombuffer(texts[d], np.uint8)
                points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                found.sort(key=lambda x: (x[1], x[3]))
                out[d] = [(kind, int(points[a]), int(points[b])) for kind, a, b, _ in found]
        return out

    def _resolve(self, k: int, text: bytes, events: list[int]) -> Iterator[tuple[int, int]]:
        """Leftmost longest matches that don't overlap, of which some end is known to be among the events."""
        rule, machine, first = self.rules[k], self.own[k], self.first[k]
        at = 0
        for event in events:
            if event <= at:
                continue
            # no start before the event was tried yet; those in vain are not tried again
            for start in (np.flatnonzero(first[np.frombuffer(text, np.uint8, event - at, at)]) + at).tolist():
                end = machine.longest(text, start)
                if end > 0:
                    found = self.check[k].fullmatch(text[start:end].decode())
                    if found and len(found[rule.group]) >= rule.least:
                        yield start, end
                    at = end
                    if end >= event:
                        break
                elif start >= at:
                    at = start + 1
            at = max(at, event)


def _scan(rules: tuple[Rule, ...], names: list[str], text: str, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, scanner = to_arrow_schema(schema), Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow.field("secret_spans").type
        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(texts, CHUNK):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner.spans(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in names] + [pa.array(found, kind)], schema=arrow)
        tidy()

    return run


def scan_secrets(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, carry: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `carry`) with secret_spans: array of (kind, start, end)."""
    names = [c for c in (docs.columns if carry is None else carry) if c != "secret_spans"]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("secret_spans", span)])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(_scan(rules, names, text, schema), schema)


def of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    kinds = [r.kind for r in BASE]
    counts = [F.size(of_kinds("secret_spans", k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = of_kinds("secret_spans", *kinds)
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def _kind_sql(rule: Rule, i: int) -> str:
    """All matches of one rule with their offsets: matches and what lies between them alternate."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT r, {i} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT r, ms[j] AS m, CAST(list_sum(list_transform(gs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS j FROM (
      SELECT r, regexp_extract_all(text, '{"(?i)" * rule.either_case}{pattern}') AS ms, string_split_regex(text, '{"(?i)" * rule.either_case}{pattern}') AS gs FROM d)))
  WHERE length(regexp_extract(m, '{"(?i)" * rule.either_case}{pattern}', {rule.group})) >= {rule.least}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(r, i) for i, r in enumerate(BASE + MORE))}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
