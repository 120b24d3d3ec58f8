"""Small tables with the cases that operators must bear."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

RARE = [
    None, "", " \t\n", "one", "two words", "a b c", "A B C", "tie tie tie tie tie tie", "x " * 200, "é ü ñ 😀 \u00a0 \u2028 x\u0301", "no\x00nul \x1c here", "w" * 30000, "a\r\nb\r\na\r\nb", "line one\nline one\nline one\n", "a a a a a b " * 40,
]


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)] + [".", "The", "END."]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    out, passage, base = list(RARE), some(70), some(90)
    for i in range(12):
        out.append(" ".join(some(rng.randint(5, 200))))
        near = list(base)
        for _ in range(i):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
        cut = rng.randrange(30)
        out.append(" ".join(some(20) + passage[cut : cut + rng.randint(33, 40)] + some(10)))
    out += [out[16], out[16], out[17], " ".join(base).upper()]
    return out


def documents(folder, rows=None, clash=True, name="documents"):
    """rows: (doc_id, text, lang, source). With `clash`, extra columns named like results."""
    if rows is None:
        rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s10", None][i % 4]) for i, t in enumerate(texts())]
        rows.append(rows[16])
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    if clash:
        columns |= {k: pa.array([7] * len(rows), pa.int32()) for k in ("kept", "n_words", "size", "row", "node", "hashes", "q_kept", "hit_n", "mix_size", "near_node", "f", "t")}
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return rows


def benchmark(folder, rows):
    pq.write_table(pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{folder}/benchmark.parquet")


def empty(folder):
    documents(folder, [])
    benchmark(folder, [])
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), f"{folder}/pages.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}), f"{folder}/conversations.parquet")
    return str(folder)


def words(text):
    return (text or "").encode().split()
