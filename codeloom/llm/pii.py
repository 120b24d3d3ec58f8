r"""Operator 4 [native]: personal data by candidates and boosted trees.

Base spans come from fixed formats and their checks, and always stay. Beside
them, two generators a kind propose spans of high recall, which overlap each
other and the base. Each candidate has small integer features: four of its format
and neighbours, one of the words before it and one of those after it. They leave
out the very check that base spans must pass (check digit, number range, leading
plus). Trees are boosted to tell candidates that meet a base span from others; a
candidate with the looks and the context of personal data that misses only the
check (a mistyped digit, a plus left out) is so found too.

Features are few and small, so all candidates of the corpus fall into at most
VALUES ** 6 cells a kind; Spark counts them over all rows, and the driver works on
the cells alone. Trees are fitted on the candidates of one half of the texts (by
hash) and calibrated on the other: isotonic regression of the share that meets a
base span, and as threshold the lowest score above which that share is at least
PRECISION, estimated as (hits + 1) / (rows + 2), so that little evidence selects
nothing. The rule is the same for any number of rows. The trees become one column
expression.

Expressions are built-in only. Offsets come from the pieces between matches:
split() and regexp_extract_all() walk a text alike, so that lengths add up; running
sums go by blocks (_scan). Patterns are possessive or start at the start of a run,
so that long texts without spaces take linear time.

Defined results: a null or empty text has no spans. Added spans never overlap a
base span of their kind or each other. Other columns are carried; the operator's
own are `pii_base` and `pii_spans`: arrays of (kind, start, end), in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("email", "ip", "card", "phone")
#: Fixed formats. `\G` lets a match begin where the one before has ended inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
WIDE = {
    "email": (r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3,7}", r"(?<![0-9.])[0-9]{1,3}+(?:[.,][0-9]{1,3}+){3}(?![0-9.])"),
    "card": (r"[0-9](?:[\x20.-]{0,2}+[0-9]){11,}+", r"(?<![0-9])[0-9]{12,19}+(?![0-9])"),
    "phone": (r"[+(]?[0-9](?:[\x20().-]{0,3}+[0-9]){8,}+", r"(?<![0-9])(?:\([0-9]{2,4}\)\x20?)?[0-9]{3,4}+[\x20.-][0-9]{3,4}+(?![0-9])"),
}
#: A quick test for any candidate, and digits that one has.
HINT = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": "[0-9][.,][0-9]", "card": "[0-9]", "phone": "[0-9]"}
N_DIGITS = {"card": (12, 19), "phone": (7, 15)}
#: Words before a candidate that announce its kind.
CUES = {"email": "mail|write|contact|reach", "ip": "ip|host|server|address|from", "card": "card|paid|pay|visa|account|charge", "phone": "call|phone|tel|fax|mobile|dial|contact"}
VALUES, FEATURES = 6, 6
ROUNDS, RATE, PRECISION = 24, 0.3, 0.85
#: Characters of context on either side, and items of a block of a running sum.
CONTEXT, BLOCK = 24, 256

SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"
CANDIDATE = "struct<start:int,base:int,end:int," + ",".join(f"f{i}:int" for i in range(FEATURES)) + ",hit:boolean>"


def _array(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What step(state, item) -> (next state, value) gives for each item, by blocks, so that time grows with the number of items."""
    none = _array(out)

    def one(a: Column, x: Column) -> Column:
        later, value = step(a["s"], x)
        return F.struct(later.alias("s"), F.array_append(a["v"], value).alias("v"))

    def every(held: Column) -> Column:
        def block(a: Column, b: Column) -> Column:
            done = F.aggregate(F.slice(held, b * BLOCK + 1, F.lit(BLOCK)), F.struct(a["s"].alias("s"), none.alias("v")), one)
            return _once(done, lambda d: F.struct(d["s"].alias("s"), F.concat(a["v"], d["v"]).alias("v")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.when(F.size(held) > 0, F.aggregate(blocks, F.struct(state.alias("s"), none.alias("v")), block, lambda a: a["v"])).otherwise(none)

    return _once(items, every)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, m, before, after) of each match, in code points; before and after: the text beside it up to the next match."""

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), F.coalesce(m, F.lit(0)).alias("m")))
        starts = _scan(sizes, F.lit(0), lambda at, x: (at + x["g"] + x["m"], at + x["g"]), "int")
        beside = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), lambda g, h: F.struct(F.right(g, F.lit(CONTEXT)).alias("before"), F.left(h, F.lit(CONTEXT)).alias("after")))
        at = F.zip_with(F.slice(starts, F.lit(1), F.size(found)), beside, lambda s, b: F.struct(s.alias("start"), b["before"].alias("before"), b["after"].alias("after")))
        return F.zip_with(found, at, lambda m, s: F.struct(s["start"].alias("start"), (s["start"] + F.length(m)).alias("end"), m.alias("m"), s["before"].alias("before"), s["after"].alias("after")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _once(found, lambda f: F.when(F.size(f) > 0, _once(F.split(text, pattern, -1), lambda g: placed(f, g))).otherwise(_array(SPAN)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    return F.lit(True)


def _has(kind: str, text: Column) -> Column:
    """A cheap test that lets most texts skip the patterns."""
    return F.instr(text, "@") > 0 if kind == "email" else (F.instr(text, "+") > 0 if kind == "phone" else F.rlike(text, F.lit("[0-9]")))


def _spans(kind: str, text: Column) -> Column:
    return F.when(_has(kind, text), F.transform(F.filter(_matches(text, BASE[kind]), lambda s: _passes(kind, s["m"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(_array("struct<start:int,end:int>"))


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(VALUES - 1)).cast("int")


def _flag(x: Column) -> Column:
    return F.when(x, 1).otherwise(0)


def _classed(text: Column, *patterns: str) -> Column:
    """The number of the first pattern that the text has."""
    out = F.lit(len(patterns))
    for i in reversed(range(len(patterns))):
        out = F.when(F.rlike(text, F.lit(patterns[i])), i).otherwise(out)
    return out


def _features(kind: str, s: Column) -> list[Column]:
    m, n = s["m"], F.length(digits(s["m"]))
    apart = _flag(~F.rlike(s["before"], F.lit("[A-Za-z0-9]$"))) + 2 * _flag(~F.rlike(s["after"], F.lit("^[A-Za-z0-9]")))
    context = [
        _classed(s["before"], r"(?i)\b(?:" + CUES[kind] + r")\b[^A-Za-z0-9]*(?:\w+\W+)?$", r"[:=]\s*$", r"(?:^|\n)\s*$", r"\b\p{Lu}\S*\s*$", r"\p{Ll}\s*$"),
        _classed(s["after"], r"^[.,;:!?)]", r"^\s*(?:$|\n)", r"^\s*\p{Lu}", r"^\s*\p{Ll}", r"^\s*[0-9]"),
    ]
    if kind == "card":
        first = F.substring(digits(m), 1, 1).cast("int")
        form = F.when(F.rlike(m, F.lit("^[0-9]+$")), 0).when(F.rlike(m, F.lit(r"^([0-9]{4}[\x20-]){3}[0-9]+$")), 1).otherwise(2)
        return [_clip(n - 12), _clip(F.when(first.between(3, 6), first - 2).otherwise(F.when(first > 6, 5).otherwise(0))), form, apart, *context]
    if kind == "ip":
        parts = F.split(m, "[.,]")
        return [_clip(F.size(parts) - 4), _clip(F.array_max(F.transform(parts, F.length)) - 1), _flag(F.exists(parts, lambda p: F.rlike(p, F.lit("^0[0-9]")))) + 2 * _flag(F.instr(m, ",") > 0), apart, *context]
    if kind == "phone":
        return [_clip(n - 7), _flag(F.instr(m, "(") > 0) + 2 * _flag(F.instr(m, ")") > 0), _clip(F.regexp_count(m, F.lit("-"))), apart, *context]
    host = F.substring_index(m, "@", -1)
    return [_clip(F.length(F.regexp_extract(m, r"([A-Za-z]*)$", 1))), _clip(F.regexp_count(host, F.lit(r"\."))), _flag(F.rlike(m, F.lit("^[A-Za-z0-9._%+-]+[@\x20\\[(]"))) + 2 * _flag(F.rlike(host, F.lit(r"^[A-Za-z0-9.-]+$"))), apart, *context]


def _candidates(kind: str, text: Column, base: Column) -> Column:
    """Spans of both generators by start, with features and whether a base span overlaps."""

    def row(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(1).alias("base"), s["end"].alias("end"), *[x.cast("int").alias(f"f{i}") for i, x in enumerate(_features(kind, s))], F.lit(False).alias("hit"))

    def other(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(0).alias("base"), s["end"].alias("end"), *[F.lit(0).alias(f"f{i}") for i in range(FEATURES)], F.lit(False).alias("hit"))

    wide = F.concat(*[_matches(text, p) for p in WIDE[kind]])
    if kind in N_DIGITS:
        wide = F.filter(wide, lambda s: F.length(digits(s["m"])).between(*N_DIGITS[kind]))
    own = F.transform(wide, row)

    def marked(rows: Column) -> Column:
        """Hits: a base span that began before ends later, or one that begins later begins inside. A span of both generators counts once."""
        def forward(a: Column, x: Column) -> tuple[Column, Column]:
            same = (x["base"] == 1) & (x["start"] == a["start"]) & (x["end"] == a["stop"])
            end = F.when(x["base"] == 0, F.greatest(a["end"], x["end"])).otherwise(a["end"])
            later = F.when(x["base"] == 1, F.struct(end.alias("end"), x["start"].alias("start"), x["end"].alias("stop"))).otherwise(F.struct(end.alias("end"), a["start"].alias("start"), a["stop"].alias("stop")))
            return later, F.struct(a["end"].alias("u"), same.alias("same"))

        until = _scan(rows, F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("start"), F.lit(-1).alias("stop")), forward, "struct<u:int,same:boolean>")
        starts = F.reverse(_scan(F.reverse(rows), F.lit((1 << 31) - 1), lambda start, x: (F.when(x["base"] == 0, x["start"]).otherwise(start), start), "int"))
        near = F.zip_with(until, starts, lambda u, v: F.struct(u["u"].alias("u"), u["same"].alias("same"), v.alias("v")))
        told = F.zip_with(rows, near, lambda x, y: F.struct(x.withField("hit", (x["start"] < y["u"]) | (y["v"] < x["end"])).alias("x"), ((x["base"] == 1) & ~y["same"]).alias("own")))
        return F.transform(F.filter(told, lambda z: z["own"]), lambda z: z["x"])

    sorted_ = _once(own, lambda o: F.when(F.size(o) > 0, _once(F.array_sort(F.concat(o, F.transform(base, other))), marked)).otherwise(_array(CANDIDATE)))
    return F.when(F.rlike(text, F.lit(HINT[kind])), sorted_.cast(f"array<{CANDIDATE}>")).otherwise(_array(CANDIDATE))


@dataclass(frozen=True)
class Tree:
    """f[a] <= at ? (f[b] <= at2 ? ..) : ..; leaves by (left, left), (left, right), (right, left), (right, right)."""

    a: int
    at: int
    b: tuple[int, int]
    at2: tuple[int, int]
    leaves: tuple[float, float, float, float]

    def value(self, f: tuple[int, ...]) -> float:
        side = int(f[self.a] > self.at)
        return self.leaves[2 * side + int(f[self.b[side]] > self.at2[side])]

    def column(self, c: Column) -> Column:
        def side(k: int) -> Column:
            return F.when(c[f"f{self.b[k]}"] <= self.at2[k], F.lit(self.leaves[2 * k])).otherwise(F.lit(self.leaves[2 * k + 1]))

        return F.when(c[f"f{self.a}"] <= self.at, side(0)).otherwise(side(1))


#: Features; rows and hits of the half that trees are fitted on; those of the other half.
Cell = tuple[tuple[int, ...], int, int, int, int]


@dataclass(frozen=True)
class Model:
    """Trees, the least score that selects (none: nothing does), and rows and hits from it upwards in the half kept back."""

    trees: list[Tree]
    least: float | None
    rows: int = 0
    hits: int = 0

    def score(self, c: Column) -> Column:
        out = self.trees[0].column(c)
        for t in self.trees[1:]:
            out = out + t.column(c)
        return out


def _split(rows: list[tuple[tuple[int, ...], float, float]]) -> tuple[float, int, int, float, float]:
    """Best (gain, feature, threshold, left leaf, right leaf) of rows (features, gradient, weight)."""
    def gain(g: float, h: float) -> float:
        return g * g / (h + 1)

    all_g, all_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (0.0, 0, VALUES, all_g / (all_h + 1), all_g / (all_h + 1))
    for k in range(FEATURES):
        by = [[0.0, 0.0] for _ in range(VALUES)]
        for f, g, h in rows:
            by[f[k]][0] += g
            by[f[k]][1] += h
        g = h = 0.0
        for at in range(VALUES - 1):
            g, h = g + by[at][0], h + by[at][1]
            if (found := gain(g, h) + gain(all_g - g, all_h - h) - gain(all_g, all_h)) > best[0] + 1e-12:
                best = (found, k, at, g / (h + 1), (all_g - g) / (all_h - h + 1))
    return best


def boost(cells: list[Cell], rounds: int = ROUNDS, rate: float = RATE) -> list[Tree]:
    """Trees of depth two on the first half's rows and hits, by Newton steps on the logistic loss."""
    score, trees = [0.0] * len(cells), []
    for _ in range(rounds):
        rows = []
        for (f, n, pos, *_), s in zip(cells, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((f, pos - n * p, n * p * (1 - p)))
        _, a, at, _, _ = _split(rows)
        halves = [_split([r for r in rows if (r[0][a] > at) == bool(k)]) for k in (0, 1)]
        leaves = tuple(rate * max(-4.0, min(4.0, x)) for h in halves for x in h[3:])
        trees.append(Tree(a, at, (halves[0][1], halves[1][1]), (halves[0][2], halves[1][2]), leaves))
        score = [s + trees[-1].value(c[0]) for s, c in zip(score, cells, strict=True)]
    return trees


def calibrated(cells: list[Cell], trees: list[Tree], precision: float = PRECISION) -> Model:
    """The model with its threshold, from the second half's rows and hits."""
    by: dict[float, list[int]] = {}
    for f, _, _, n, pos in cells:
        held = by.setdefault(round(sum(t.value(f) for t in trees), 9), [0, 0])
        held[0] += n
        held[1] += pos
    pools: list[list[float]] = []  # score, rows, hits; shares rise
    for s in sorted(by):
        pools.append([s, *by[s]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, pos = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += pos
    best, rows, hits = Model(trees, None), 0, 0
    for s, n, pos in reversed(pools):
        rows, hits = rows + n, hits + pos
        if hits + 1 >= precision * (rows + 2):
            best = Model(trees, s - 1e-6, rows, hits)
    return best


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """The row, the half of its text, and base spans and candidates of each kind."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("row", "t", F.pmod(F.xxhash64("t"), F.lit(2)).alias("half"), *[_spans(k, F.col("t")).alias(f"b_{k}") for k in KINDS])
    return rows.select("row", "half", *[f"b_{k}" for k in KINDS], *[_candidates(k, F.col("t"), F.col(f"b_{k}")).alias(f"c_{k}") for k in KINDS])


def fit(docs: DataFrame, *, text: str = "text", precision: float = PRECISION) -> dict[str, Model]:
    """A model of each kind that has candidates, from all of them."""
    found = _prepared(docs.select(text), text)
    every = F.concat(*[_tagged(k) for k in KINDS])
    names = [f"f{i}" for i in range(FEATURES)]
    flat = found.select("half", F.explode(every).alias("x")).select("half", "x.kind", *[F.col(f"x.c.{f}").alias(f) for f in names], F.col("x.c.hit").cast("long").alias("hit"))
    counts = [F.sum(F.when(F.col("half") == h, v).otherwise(0)).alias(f"{n}{h}") for h in (0, 1) for n, v in (("n", F.lit(1)), ("pos", F.col("hit")))]
    by: dict[str, list[Cell]] = {}
    for r in flat.groupBy("kind", *names).agg(*counts).collect():  # at most len(KINDS) * VALUES ** FEATURES rows
        by.setdefault(r["kind"], []).append((tuple(r[f] for f in names), r["n0"], r["pos0"], r["n1"], r["pos1"]))
    return {kind: calibrated(sorted(cells), boost(sorted(cells)), precision) for kind, cells in by.items()}


def _tagged(kind: str) -> Column:
    return F.transform(f"c_{kind}", lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))


def _chosen(kind: str, models: dict[str, Model]) -> Column:
    """Base spans, and candidates over the threshold, by start; of two that overlap the one that begins first, then the longer."""
    base, model = _named(kind, F.col(f"b_{kind}")), models.get(kind)
    if model is None or model.least is None:
        return base

    def apart(found: Column) -> Column:
        longest = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("to"), c["end"].alias("end"))))

        def kept(rows: Column) -> Column:
            keep = _scan(rows, F.lit(-1), lambda end, x: (F.when(x["start"] >= end, x["end"]).otherwise(end), x["start"] >= end), "boolean")
            return F.filter(F.zip_with(rows, keep, lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), k.alias("k"))), lambda x: x["k"])

        return F.array_sort(F.concat(base, _named(kind, _once(longest, kept))))

    over = F.filter(f"c_{kind}", lambda c: ~c["hit"] & (model.score(c) >= model.least))
    return _once(over, lambda found: F.when(F.size(found) > 0, apart(found)).otherwise(base))


def find_pii(docs: DataFrame, *, text: str = "text", models: dict[str, Model] | None = None) -> DataFrame:
    """`docs` with pii_base and pii_spans, by kind as listed, then by start."""
    models = fit(docs, text=text) if models is None else models
    kept = [c for c in docs.columns if c not in ("pii_base", "pii_spans")]
    found = _prepared(docs.select(*kept), text)
    return found.select("row.*", F.concat(*[_named(k, F.col(f"b_{k}")) for k in KINDS]).alias("pii_base"), F.concat(*[_chosen(k, models) for k in KINDS]).alias("pii_spans"))


def redact(found: DataFrame, *, text: str = "text", column: str = "pii_text") -> DataFrame:
    """With the text, each run of overlapping spans replaced by its first kind in brackets."""
    spans = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        piece = F.when(new, F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"])
        return F.struct(piece.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return found.withColumn(column, F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text)))))


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[_number(k) for k in KINDS], F.sha2(joined("pii_base").cast("binary"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
