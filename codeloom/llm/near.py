"""Operator 2: near-duplicates by SuperMinHash.

1. One pass over the texts: distinct shingles, their SuperMinHash signature
   (below), and its bands. Texts of equal words are one node (128 bits of BLAKE2
   over the words), so that copies cost one row each and no links.
2. Banding: nodes that share a bucket of a band are candidates. The node that
   shares buckets with most others leads its buckets; every other node of a bucket
   is verified against the leader on the full shingle sets, never against all.
   Nodes of buckets with one leader form the leader's star.
3. Verified links are grouped: union-find inside tasks, then alternating star
   contractions between them, until nothing changes.
4. A star that lies in one group is done. In any other, all pairs of different
   groups are compared, star by star: its nodes are dealt to blocks of a bounded
   number of nodes and shingles, and every two blocks meet in a unit, where an
   inverted index of their shingles counts what each node has in common with all
   others. A unit tells no pairs, only the links that join groups. Before that, a
   star of more than one block loses nodes that can't be linked beside its leader
   L. Linked sets have at least 4/9 of the sum of their sizes in common, and
   outside of L at least that less what either shares with L. So a link between x
   and y, in different groups, shows in one of two ways, and only such nodes stay:
   - they have a shingle in common that L lacks. Prefix filter: with the shingles
     that L lacks ordered by how many nodes of the star have them, one of the first
     |x without L| - t + 1 is in common, where t is the least overlap that links x with
     any node of the star;
   - all they have in common is in L. Since one of them isn't linked with L, the
     other must then be smaller than L.
   No star gives rise to others, so that the work is bounded by the stars of 2. No
   pair of candidates is left undecided, and none is dropped unless a bound rules
   its link out.

SuperMinHash (Ertl 2017): instead of independent hash functions, every element
walks one random permutation of the signature's places; its j-th place gets
j + (a random fraction). Ranks of one element are correlated, which lowers the
variance, and a text is done as soon as all places hold less than j. Here one
step j is taken for all unfinished texts of a batch at once.

With BANDS bands of ROWS values, a pair of similarity 0.8 shares no bucket with
probability (1 - 0.8**ROWS)**BANDS, 3e-6. Shingles are compared by 64 bits inside
a pair; a wrong verdict needs an accidental collision within it.

Defined results: null, empty and wordless texts have no shingle and are
linked with nothing: they are their own component. A null doc_id counts as
larger than others. Repeated rows are each returned, in one component. Other
columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written
from .words import NOT_SPACE, U64, Windows, Words, mix, pieces, tidy, utf8

SHINGLE, PLACES, ROWS = 5, 96, 4
BANDS = PLACES // ROWS
#: Links need 100 * common >= 80 * all.
PERCENT = 80
#: So many links or fewer are grouped by union-find in one task.
SOLO = 1 << 17
#: A block of a star has about so many nodes and shingles, or one node of more.
BLOCK_NODES, BLOCK_SHINGLES = 1 << 10, 1 << 19
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BLANK = np.uint32(0xFFFFFFFF)
OWNER = U64(0xA0761D6478BD642F)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, and the text of each, in order of texts."""
    windows = Windows(words.hashes())
    found, owner = windows.every(size), words.text_of()
    start = np.flatnonzero(np.arange(len(found)) + size <= words.first[1:][owner[: len(found)]])
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    values = np.concatenate((found[start], windows.of(words.first[few], words.first[few + 1])))
    texts = np.concatenate((owner[start], few))
    keys = mix(values ^ (texts.astype(U64) * OWNER))
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.sort(order[np.concatenate(([True], ordered[1:] != ordered[:-1]))]) if len(order) else order
    values, texts = values[first], texts[first]
    if len(few):
        order = np.argsort(texts, kind="stable")
        values, texts = values[order], texts[order]
    return values, texts


def super_minhash(values: np.ndarray, texts: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n x places); place values are j * 2**24 + a fraction of 24 bits."""
    out = np.full(n * places, BLANK, np.uint32)
    perm: np.ndarray | None = None
    for j in range(places):
        draw = mix(values + U64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = (j + ((draw & U64(0xFFFFFFFF)) * U64(places - j) >> U64(32))).astype(np.int64)
        rank = (draw >> U64(40)).astype(np.uint32) | np.uint32(j << 24)
        if perm is None:
            at = swap
        else:
            row = np.arange(len(values))
            at = perm[row, swap].astype(np.int64)
            perm[row, swap] = perm[:, j]
            perm[:, j] = at
        np.minimum.at(out, texts * places + at, rank)
        # early stop: texts whose places all hold less than the next rank are done
        open_ = out.reshape(n, places).max(axis=1) >= np.uint32((j + 1) << 24) if j + 1 < 256 else np.zeros(n, bool)
        stay = open_[texts]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(places, dtype=np.uint8), (int(stay.sum()), 1))
            row, swap = np.arange(len(perm)), swap[stay]
            perm[:, 0] = swap
            perm[row, swap] = 0
        elif not stay.all():
            perm = perm[stay]
        values, texts = values[stay], texts[stay]
    return out.reshape(n, places)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(U64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.astype(np.int64)


def digests(texts: list[bytes | None]) -> list[bytes | None]:
    """128 bits of the word sequence of each text; null without words."""
    words = [(t or b"").translate(FOLD).split() for t in texts]
    return [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in pieces(texts):
                values, owner = shingles(Words(texts[a:b], NOT_SPACE, FOLD), size)
                keys = band_keys(super_minhash(values, owner, b - a))
                n = np.bincount(owner, minlength=b - a)
                offsets = pa.array(np.arange(b - a + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests(texts[a:b]), pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["doc_id", "digest", "n_shingles", "bands"])
        tidy()

    return run


def _digested(names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(digests(texts[a:b]), pa.binary())], [*batch.schema.names, "near_node"])
        tidy()

    return run


def with_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with near_node: equal for texts of equal words."""
    return docs.mapInArrow(_digested(docs.columns, text), T.StructType([*docs.schema.fields, T.StructField("near_node", T.BinaryType())]))


def _compared(size: int, outside: bool):
    """(node, leader, node's text, leader's text) -> whether they are linked, or (`outside`) sizes and the node's shingles that the leader lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaders, texts, leading = batch.column(1).to_numpy(), utf8(batch.column(2)), batch.column(3)
            new = np.concatenate(([True], leaders[1:] != leaders[:-1]))
            for a, b in pieces(texts):
                # rows come by leader: its text is taken once a run
                heads = np.flatnonzero(new[a:b] | (np.arange(b - a) == 0))
                which = np.searchsorted(heads, np.arange(b - a), "right") - 1
                values, owner = shingles(Words(texts[a:b], NOT_SPACE, FOLD), size)
                count = np.bincount(owner, minlength=b - a)
                led, lacks = np.zeros(len(heads), np.int64), np.ones(len(values), bool)
                heading = utf8(leading.take(pa.array(heads + a)))
                for i, j in pieces(heading):
                    theirs, of = shingles(Words(heading[i:j], NOT_SPACE, FOLD), size)
                    led[i:j] = np.bincount(of, minlength=j - i)
                    known = np.sort(mix(theirs ^ (of.astype(U64) * OWNER)))
                    mine = np.flatnonzero((which[owner] >= i) & (which[owner] < j))
                    if len(known) and len(mine):
                        keys = mix(values[mine] ^ ((which[owner[mine]] - i).astype(U64) * OWNER))
                        lacks[mine] = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys
                common = np.bincount(owner[~lacks], minlength=b - a)
                ids = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                if outside:
                    offsets = np.concatenate(([0], np.cumsum(count - common)))
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(common, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[lacks].astype(np.int64)))], ["node", "leader", "common", "lacks"])
                else:
                    total = count + led[which] - common
                    yield pa.RecordBatch.from_arrays([*ids, pa.array((100 * common >= PERCENT * total) & (total > 0))], ["node", "leader", "linked"])
        tidy()

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a batch: (member, root) for each node that is not a root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * SOLO:
            yield out()
            parent.clear()
    yield out()


def components(links: DataFrame, solo: int = SOLO) -> DataFrame:
    """links (u, v) of longs -> (node, comp) for every node with a link that is not the smallest of its component, comp."""
    edges = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = written(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.count_distinct("u").alias("k")).first()
        if now["n"] <= solo:
            edges = written(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
        if now["n"] <= solo or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now
        # large star: neighbours larger than a node get the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: a node and its smaller neighbours get the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "edges")


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups (node, comp) after further links (u, v)."""
    if groups is None:
        return components(links)
    g, h = groups.select(F.col("node").alias("g"), F.col("comp").alias("gc")), groups.select(F.col("node").alias("h"), F.col("comp").alias("hc"))
    between = links.join(g, F.col("u") == F.col("g"), "left").join(h, F.col("v") == F.col("h"), "left")
    between = between.select(F.coalesce("gc", "u").alias("u"), F.coalesce("hc", "v").alias("v")).filter("u != v")
    later = components(between)
    moved = groups.join(later.select(F.col("node").alias("was"), F.col("comp").alias("now")), F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    return written(moved.unionByName(later), "groups")


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of `nodes` (node, digest, least_id), one copy each."""
    wanted = nodes.select("node", F.col("digest").alias("near_digest"), F.col("least_id").alias("near_least"))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("near_least"))).select("node", "near_digest", "text")
    # rows may share a doc_id
    found = with_nodes(found).filter(F.col("near_node") == F.col("near_digest"))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (node, leader) with both texts."""
    one, two = texts.select(F.col("node").alias("o"), F.col("text").alias("to")), texts.select(F.col("node").alias("l"), F.col("text").alias("tl"))
    return pairs.join(one, F.col("node") == F.col("o")).join(two, F.col("leader") == F.col("l")).select("node", "leader", "to", "tl")


def _mixed(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """Stars (key, leader, node, n) without their leader, that lie in more than one group: with comp, whether the leader's group is another (open), and the least size."""
    grouped = stars.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lead = groups.select(F.col("node").alias("g"), F.col("comp").alias("lead"))
    sizes = grouped.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min("n").alias("least")).filter("c < d").select("key", "least")
    found = grouped.join(sizes, "key").join(lead, F.col("leader") == F.col("g"), "left")
    return found.select("key", "leader", "node", "n", "comp", "least", (F.col("comp") != F.coalesce("lead", "leader")).alias("open"))


def _narrowed(mixed: DataFrame, compared: DataFrame) -> DataFrame:
    """(key, node) of `mixed` that may still be linked beside their leader."""
    rows = mixed.join(compared, ["node", "leader"])
    # what a linked pair has in common outside the leader is at least this
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
    need = F.greatest(F.lit(1), F.ceil((PERCENT * (F.col("n") + least) - (100 + PERCENT) * F.col("common")) / (100 + PERCENT)))
    cap = F.floor(F.col("common") * (100 + PERCENT) / PERCENT) - F.col("n")
    rows = written(rows.select("key", "node", "n", "comp", "open", "least", cap.alias("cap"), (F.size("lacks") - need + 1).alias("prefix"), "lacks"), "lacking")
    element = F.xxhash64("key", "e").alias("h")
    spread = rows.filter("prefix > 0").select("key", "node", F.explode("lacks").alias("e")).select("node", "key", element)
    often = spread.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").withColumnRenamed("h", "often")
    shared = spread.join(often, F.col("h") == F.col("often")).groupBy("key", "node").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("held"))
    # shingles of one node only come first in the order
    rest = F.col("prefix") - (F.size("lacks") - F.size("held"))
    found = rows.join(shared, ["key", "node"]).filter(rest > 0)
    found = found.select("key", "node", "comp", F.explode(F.slice("held", F.lit(1), F.least(rest.cast("int"), F.size("held")))).alias("x")).select("key", "node", "comp", "x.h")
    met = found.groupBy("h").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c < d").select(F.col("h").alias("met"))
    beyond = found.join(met, F.col("h") == F.col("met"), "left_semi").select("key", "node")
    # all in common lies in the leader: one is not in its group, the other small enough for it
    most = rows.filter("open").groupBy("key").agg(F.max("cap").alias("most"), F.min("n").alias("few")).withColumnRenamed("key", "star")
    inside = rows.join(most, F.col("key") == F.col("star")).filter((F.col("open") & (F.col("cap") >= F.col("least"))) | ((F.col("n") <= F.col("most")) & (F.col("cap") >= F.col("few"))))
    return beyond.unionByName(inside.select("key", "node")).distinct()


def _blocks(mixed: DataFrame, nodes: int, most: int) -> DataFrame:
    """Stars with the number of blocks of each."""
    sizes = mixed.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / nodes, F.sum("n") / most)).cast("int").alias("blocks"))
    return mixed.join(sizes, "key")


def _units(blocked: DataFrame) -> DataFrame:
    """(key, i, j, node, side, comp): every two blocks i and j of a star, or one with itself, and their nodes."""
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = blocked.select("key", "node", "comp", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "comp")


def joined(values: np.ndarray, owner: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Of nodes with these distinct shingles (value and owner of each), pairs that are linked and join all groups that links join; with two sides, only links between them count."""
    n, parent = len(groups), {}
    size = np.bincount(owner, minlength=n)
    _, group = np.unique(groups, return_inverse=True)
    order = np.argsort(values, kind="stable")
    values, posts = values[order], owner[order]
    head = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    start = np.flatnonzero(head)
    count = np.diff(np.append(start, len(values)))
    name = np.cumsum(head) - 1
    # shingles of one node only are in no pair
    shared = np.flatnonzero(count[name] > 1)
    by = shared[np.argsort(posts[shared], kind="stable")]
    first = np.searchsorted(posts[by], np.arange(n + 1))
    across, out = len(np.unique(sides)) > 1, []

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = int(group.max()) + 1 if n else 0
    for x in range(n):
        if left == 1:
            break
        mine = name[by[first[x] : first[x + 1]]]
        if not len(mine):
            continue
        many = count[mine]
        at = np.repeat(start[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(posts[at], minlength=n)
        linked = (100 * common >= PERCENT * (size[x] + size - common)) & (group != group[x])
        linked[: x + 1] = False
        if across:
            linked &= sides != sides[x]
        for y in np.flatnonzero(linked).tolist():
            a, b = find(int(group[x])), find(int(group[y]))
            if a != b:
                parent[a] = b
                left -= 1
                out.append((x, y))
    return out


def _met(size: int):
    """(key, i, j, node, side, comp, text), unit after unit -> links (u, v) between groups."""

    def solved(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        values, owners = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for a, b in pieces(texts):
            value, owner = shingles(Words(texts[a:b], NOT_SPACE, FOLD), size)
            values.append(value)
            owners.append(owner + a)
        comps, sides = np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        links = joined(np.concatenate(values), np.concatenate(owners), comps, sides)
        return pa.RecordBatch.from_arrays([pa.array([rows[k[e]][0] for k in links], pa.int64()) for e in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for *unit, node, side, comp, text in zip(*columns, utf8(batch.column(6)), strict=True):
                if unit != now:
                    if rows:
                        yield solved(rows)
                    now, rows = unit, []
                rows.append((node, side, comp, text))
        if rows:
            yield solved(rows)
        tidy()

    return run


def _between(mixed: DataFrame, texts: DataFrame, size: int, nodes: int, most: int) -> DataFrame:
    """Links (u, v) between groups inside the stars of `mixed`."""
    blocked = written(_blocks(mixed, nodes, most), "blocked")
    large = blocked.filter("blocks > 1")
    if not large.isEmpty():
        some = texts.join(large.select(F.explode(F.array("node", "leader")).alias("node")).distinct(), "node", "left_semi")
        compared = _beside(large.select("node", "leader").distinct(), written(some, "near-texts")).mapInArrow(_compared(size, True), "node long, leader long, common long, lacks array<long>")
        fewer = written(large.join(_narrowed(large, compared), ["key", "node"], "left_semi").drop("blocks"), "narrowed")
        blocked = blocked.filter("blocks = 1").unionByName(_blocks(fewer, nodes, most).select(*blocked.columns))
    met = _units(blocked).join(texts, "node").select("key", "i", "j", "node", "side", "comp", "text")
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_met(size), "u long, v long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, near_node and near_group (of the component; null without words) of each row of `docs`."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(rows.mapInArrow(_sign(shingle), "doc_id long, digest binary, n_shingles long, bands array<long>"), "signatures")
    nodes = signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").withColumnRenamed("key", "shared")
    members = written(members.join(shared, F.col("key") == F.col("shared")).select("key", "node", "n", "k"), "members")
    weights = written(members.groupBy("node").agg(F.sum("k").alias("weight")), "weights")
    texts = written(_texts(rows, nodes.join(weights, "node", "left_semi")), "near-texts")

    # a bucket's leader; buckets of one leader are one star
    leader = members.join(weights, "node").groupBy("key").agg(F.max_by("node", "weight").alias("leader"))
    led = members.join(leader, "key").filter("node != leader").groupBy("leader", "node").agg(F.first("n").alias("n"))
    led = written(led.withColumn("key", F.col("leader")), "led")
    linked = _beside(led.select("node", "leader"), texts).mapInArrow(_compared(shingle, False), "node long, leader long, linked boolean").filter("linked")
    groups = components(written(linked.select(F.col("node").alias("u"), F.col("leader").alias("v")), "links"))
    mixed = written(_mixed(led, groups), "mixed")
    if not mixed.isEmpty():
        groups = _merged(groups, written(_between(mixed, texts, shingle, block_nodes, block_shingles), "links"))

    ids = nodes.join(groups, "node", "left").select("digest", "least_id", F.coalesce("comp", "node").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = ids.select("digest", "comp").join(least, "comp").select(F.col("digest").alias("near_node"), F.col("comp").alias("near_group"), "component_id")
    some = signed.filter(F.col("digest").isNotNull()).select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("near_node"))
    none = signed.filter(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("digest").alias("near_node"), F.lit(None).cast("long").alias("near_group"))
    return some.select(*none.columns).unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, their exact similarity, and the closure of the links.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.k + ny.k - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
