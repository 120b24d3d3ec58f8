"""Pages, conversations, the automaton, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeloom.llm import automaton, chat, mixing, near, urls
from tests.llm import fixture
from tests.llm.test_documents import components, expected, five_words, found


def judged(url, rules=urls.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [None, "", "nothing", "http://", "http://net", "HTTP://A.NET/x", "https://example.net/en/1?q#f", "https://example.net/enx", "x://www.example.com/de/", "x://example.com/fr/", "a://b.org/fr/?x", "a://fr.org/fr", "a://evilnet/", "a://notexample.net/en/x", "http://net/#a://b", "http://a.net?x=/", "http://ÄÖ.NET/ß", "http://a.net:80/"]


def test_urls(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[6]), (None, URLS[6])]
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "host": ["x"] * len(rows), "verdict": ["y"] * len(rows)}), f"{tmp_path}/pages.parquet")
    assert found(urls.op9_urls(spark, str(tmp_path))) == expected((i, *judged(u)) for i, u in rows)


def test_many_rules(spark):
    rng = random.Random(3)
    rules = sorted({(f"h{rng.randrange(300)}.c{rng.randrange(3)}/" + rng.choice(["", "a/", "a/b/", "aa"]), rng.choice(["allow", "block"])) for _ in range(700)})
    one = dict(rules)
    pages = [(i, f"http://{rng.choice(['', 'www.', 'x.y.'])}h{rng.randrange(400)}.c{rng.randrange(4)}/{rng.choice(['', 'a', 'a/', 'a/b/c', 'aab'])}") for i in range(800)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(one.items()), "rule string, verdict string"))
    assert found(got.select("page_id", "url_host", "url_path", "url_rule", "url_verdict")) == expected((i, *judged(u, one.items())) for i, u in pages)
    none = urls.judge(spark.createDataFrame(pages[:3], "page_id long, url string"), spark.createDataFrame([], "rule string, verdict string"), default="block")
    assert {r["url_verdict"] for r in none.collect()} == {"block"}


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x: </turn> \\</turn> \\\\### "), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, None, "###"), (2, 1, "assistant", "é😀 " * 50), (2, 1, "assistant", "é😀 " * 50), (2, 1, "Assistant", "no"), (3, 0, "a: ### b", "w" * 9000), (None, None, "assistant", "</turn>"), (None, None, "user", "</tur"), (4, 0, "assistant", "<|endoftext|>"), (5, 0, "user", "zebra"), (5, 0, "user", "apple"), (5, 0, "user", "b"), (5, None, "user", "last"), (5, -1, "x", "é"), (5, -1, "x", "z"), (5, -1, "x", "😀"), (5, -1, "x", "\uffee")]


def test_chat(spark, tmp_path):
    cols = list(zip(*TURNS, strict=True))
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string()), "ids": [1] * len(TURNS)}), f"{tmp_path}/conversations.parquet")
    rows = [*TURNS, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda y: (*y[:2], y[2].encode(), y[3].encode()))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        out.append((c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(15 + len(chat.escape(r)) + len(chat.escape(x)) for *_, r, x in own)))
    assert found(chat.op6_chat(spark, str(tmp_path))) == expected(out)


def test_chat_offsets_and_masks(spark):
    import public_tokenizers

    path, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    code, at = chat.codec(path, pattern), {}
    for r in chat.format_turns(df, path, pattern).collect():
        assert r["start"] == at.get(r["conv_id"], 0)
        at[r["conv_id"]] = r["start"] + len(r["ids"])
        assert r["ids"][0] == code.head and r["ids"][-1] == code.end and r["ids"].count(code.role) == 1
        masked = [i for i, m in zip(r["ids"], r["loss_mask"], strict=True) if m]
        assert not {code.head, code.role, code.end} & set(masked)


def test_long_texts_encode_like_whole_ones(monkeypatch):
    import public_tokenizers

    code = chat.Codec(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "\n\n ", "word", "don't", "é", "12345", "!!", "\t", "😀", "x"]) for _ in range(300))
        monkeypatch.setattr(chat, "PART", rng.randint(60, 120))
        parts = list(code.parts(text))
        assert "".join(parts) == text and max(map(len, parts)) <= chat.PART
        assert np.frombuffer(code.encode(text), code.kind).tolist() == code.encoding.encode_ordinary(text)
    assert list(code.parts("x" * 200)) == ["x" * min(chat.PART, 200 - i) for i in range(0, 200, chat.PART)]


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(7)
    rules = {f"h{i}.c{i % 7}/" + ["", "a/", "a/b/", "aa"][i % 4]: ["allow", "block"][i % 2] for i in range(100_000)}
    pages = [(i, f"http://{rng.choice(['', 'www.', 'x.y.'])}h{rng.randrange(120_000)}.c{rng.randrange(7)}/{rng.choice(['', 'a', 'a/', 'a/b/c', 'aab'])}") for i in range(3000)]
    listed = spark.range(100_000).selectExpr("concat('h', id, '.c', id % 7, '/', element_at(array('', 'a/', 'a/b/', 'aa'), cast(id % 4 as int) + 1)) AS rule", "element_at(array('allow', 'block'), cast(id % 2 as int) + 1) AS verdict")
    got = {r["page_id"]: (r["url_rule"], r["url_verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), listed).collect()}
    assert sum(v[0] is not None for v in got.values()) > 100
    for i, u in pages:
        h, _, p = u[7:].partition("/")
        keys = [f"{h.split('.', k)[-1]}/{p[:n]}" for k in range(h.count(".") + 1) for n in range(len(p) + 1)]
        best = max((k for k in keys if k in rules), key=len, default=None)
        assert got[i] == (best, rules.get(best, "allow"))


def test_escape_is_reversible():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "### ", "</turn>", "#", " ", "x", "</", "turn>"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"(?<!\\)(### |</turn>)", chat.escape(text))


@pytest.mark.parametrize("pattern", [r"a(b|c)*d", r"[^a]b?", r"x{2,3}y", r"(ab|a)c{2}", r"a+b+", r"(?:ab)*c", r"\x41\.", r"a{2,}"])
def test_automaton_equals_re(pattern):
    machine, search, plain = automaton.compile_rules([(pattern, False)], search=False), automaton.compile_rules([(pattern, False)], search=True), re.compile(pattern.encode())
    rng = random.Random(8)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdxyA.") for _ in range(12))
        for i in range(len(data)):
            ends = [j for j in range(i + 1, len(data) + 1) if plain.fullmatch(data, i, j)]
            assert machine.longest(data, i) == max(ends, default=-1)
        state, hit = search.start, False
        for b in data:
            state = int(search.next[state * search.n_classes + search.byte_class[b]])
            hit |= state >= search.first_accept
        assert hit == any(plain.fullmatch(data, i, j) for i in range(len(data)) for j in range(i + 1, len(data) + 1))


def test_automaton_tells_rules_apart():
    m = automaton.compile_rules([("ab", False), ("b", True), ("cb", False)], search=True)
    state = m.start
    for b in b"aB":
        state = int(m.next[state * m.n_classes + m.byte_class[b]])
    assert m.rules[state] == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = fixture.documents(tmp_path)
    some = [r for r in rows if r[1] and len(r[1].split()) > 60]
    fixture.benchmark(tmp_path, [(1, " ".join(some[2][1].split()[:30]))])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, held = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        held.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    for df in held[1:5]:
        assert df.columns == columns
    kept = [[(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()] for df in held[:5]]
    assert 0 < len(kept[1]) < len(kept[0]) and set(kept[1]) <= set(kept[0])
    _, least = components(kept[1], five_words)
    assert sorted(kept[2]) == sorted({r for r, c in zip(kept[1], least, strict=True) if r[0] == c}) and len(kept[2]) < len(kept[1])
    assert set(kept[3]) <= set(kept[2])
    mixed = mixing.mix(held[3].select("doc_id", "text", "source")).collect()
    assert len(kept[4]) == sum(r["mix_times"] for r in mixed)
    assert held[5].count() == len(kept[4]) and held[5].agg(F.min("start")).first()[0] == 0
    assert near.SHINGLE == 5 and corpus_pipeline.ORACLE_SQL is None


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codeloom.llm.shared import shared_dir

    empty = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=empty, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: empty))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)
    named = SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/" if key == "spark.checkpoint.dir" else default)
    assert shared_dir(SimpleNamespace(conf=named)) == "hdfs://x/y"
