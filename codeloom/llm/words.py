"""Vectorised words of many texts: byte buffer in, numpy arrays out.

Every text operator here works on UTF-8 bytes, so that one pass of numpy
handles a whole Arrow batch, and never makes a Python object for each word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes of text that are handled at once (a longer text makes a longer piece).
CHUNK_BYTES = 1 << 20

#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Two independent families of word hashes: a seed and an odd multiplier each.
SEEDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))
FACTORS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
#: Words hashed at once; bounds what is held besides, however long a text is.
AT_ONCE = 1 << 18
#: Words of more bytes than this are hashed one by one by the library.
LONG_WORD = 256
#: Keeps the first 0 to 8 bytes of a little-endian integer.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (xor-shifts and odd multipliers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` bytes each."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text or b"") + 1
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of several texts, in order.

    start, end: bytes in `data`; of: word range of text i is first[i] .. first[i + 1].
    """

    def __init__(self, texts: list[bytes | None], keep: np.ndarray = NOT_SPACE, fold: bytes | None = None):
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        if fold:
            joined = joined.translate(fold)
        self.raw, self.data = joined, np.frombuffer(joined, np.uint8)
        inside = keep[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, family: int = 0) -> np.ndarray:
        """64 bits for each word, the same for equal words in any task.

        Eight bytes a step go through a mixer, all words in step; a long word has its BLAKE2 digest.
        """
        out = np.empty(len(self), U64)
        padded = self.raw + bytes(8)
        eight = np.ndarray(len(self.raw), "<u8", padded, strides=(1,))
        for i in range(0, len(out), AT_ONCE):
            self._hash(out[i : i + AT_ONCE], eight, self.start[i : i + AT_ONCE], self.end[i : i + AT_ONCE], family)
        return out

    def _hash(self, out: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray, family: int) -> None:
        size, seed, factor = end - start, SEEDS[family], FACTORS[family]
        out[:] = mix(size.astype(U64) * factor + seed)
        many = np.flatnonzero(size > LONG_WORD)
        now = np.arange(len(size)) if not len(many) else np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            if at:
                now = now[size[now] > at]
            if not len(now):
                break
            every = len(now) == len(size)
            begin, rest, held = (start, size, out) if every else (start[now], size[now], out[now])
            mixed = mix(held ^ ((eight[begin + at] & FIRST_BYTES[np.minimum(rest - at, 8)]) * factor + seed))
            if every:
                out[:] = mixed
            else:
                out[now] = mixed
        for i in many.tolist():
            digest = hashlib.blake2b(self.raw[start[i] : end[i]], digest_size=16).digest()
            out[i] = np.frombuffer(digest, "<u8")[family]

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def span(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.raw[self.start[i] : self.end[j - 1]].split()) if j > i else b""


class Windows:
    """Hashes of any run of words, by doubling: a run of 2**k words is named by its two halves.

    Any other run is named by its size and the two runs of a power of two that cover it.
    """

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half = 1 << (len(self.levels) - 1)
            below = self.levels[-1]
            self.levels.append(self._pair(below[:-half], below[half:], len(self.levels)) if len(below) > half else below[:0])
        return self.levels[k]

    @staticmethod
    def _pair(first: np.ndarray, second: np.ndarray, salt) -> np.ndarray:
        return mix((first ^ (first >> U64(29))) * FACTORS[0] + second * FACTORS[1] + (U64(salt) if isinstance(salt, int) else salt))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out, power = np.zeros(len(start), U64), np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(power).tolist():
            mine = (power == k) & (size > 0)
            runs, n = self.level(k), size[mine]
            if len(runs):
                out[mine] = self._pair(runs[start[mine]], runs[end[mine] - (1 << k)], n.astype(U64) << U64(8))
        return out

    def every(self, size: int) -> np.ndarray:
        """Hash of each window of `size` words, by its first word."""
        n = len(self.levels[0]) - size + 1
        if n <= 0:
            return np.empty(0, U64)
        k = size.bit_length() - 1
        # levels that nobody else asked for are not kept
        runs = self.levels[min(k, len(self.levels) - 1)]
        for j in range(len(self.levels), k + 1):
            half = 1 << (j - 1)
            runs = self._pair(runs[:-half], runs[half:], j)
        return self._pair(runs[:n], runs[size - (1 << k) : size - (1 << k) + n], size << 8)


def tidy() -> None:
    """Gives freed memory back to the system; for the end of a task, as its worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def carried(batch: pa.RecordBatch, names: list[str], first: int, last: int) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)).slice(first, last - first) for n in names]
