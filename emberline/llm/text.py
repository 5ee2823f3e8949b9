"""Vectorised byte-level text primitives for code that runs on executors.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. No byte of a
multi-byte UTF-8 character is in that set, so words can be found in the bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np

U64 = np.uint64
#: Bytes hashed at once; tables of powers have this size.
SLICE = 1 << 20
IS_SPACE = np.zeros(256, bool)
#: Bytes between bare words: white space and ASCII punctuation.
IS_MARK = np.zeros(256, bool)
IS_MARK[[*range(9, 14), *range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n."""
    out = np.ones(max(n, 1), U64)
    filled, step = 1, np.array([base % 2**64], U64)
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * step
        filled, step = filled + m, step * step
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        size = max(n, SLICE + 1)
        _TABLES["p"], _TABLES["q"] = power_table(BASE, size), power_table(pow(BASE, -1, 2**64), size)
    return _TABLES["p"], _TABLES["q"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of bytes, both ascending."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        low, high = int(start[i]), int(end[j - 1])
        p, q = _powers(high - low + 1)
        acc = np.zeros(high - low + 1, U64)
        np.cumsum(BYTE_VALUE[data[low:high]] * p[: high - low], out=acc[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = (acc[b] - acc[a]) * q[a]
        i = j
    return mix(out + (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def sequence_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values of an array."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out, step = np.empty(n, U64), SLICE
    for a in range(0, n, step):
        part = values[a : min(n, a + step) + width - 1]
        p, q = _powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, U64)
        np.cumsum(part * p[: len(part)], out=acc[1:])
        m = len(part) - width + 1
        out[a : a + m] = (acc[width:] - acc[:m]) * q[:m]
    return mix(out)


class Words:
    """The words of several texts: bytes, spans, and the first word of each text.

    ``first`` has one entry more than there are texts; text i has the words
    first[i] up to, not including, first[i + 1].
    """

    def __init__(self, texts: list[bytes], lower: bool = False, apart: np.ndarray = IS_SPACE):
        """``apart`` marks the bytes between words; it must mark the line feed."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        space = apart[self.data]
        inside = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            inside = np.concatenate(([0], inside))
        self.start, self.end = inside[0::2].copy(), inside[1::2].copy()
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(data)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_column(batch, name: str = "text") -> list[bytes]:
    """A text column of an Arrow batch as bytes; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


#: Rows of an Arrow batch that are turned into Python objects at once.
ROWS_AT_ONCE = 512
#: Groups of texts after which a task gives freed memory back.
TRIM_EVERY = 16


def give_back() -> None:
    """Return memory that Arrow's pool and the C library hold but don't use; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def grouped(batches, budget: int, columns: list[str]):
    """Lists of rows' columns from Arrow batches, with about ``budget`` bytes of text each.

    Yields (texts, {column: values}). A text beyond the budget comes alone.
    """
    texts: list[bytes] = []
    rest: dict[str, list] = {c: [] for c in columns}
    size = groups = 0
    for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
        values = {c: batch.column(c).to_pylist() for c in columns}
        for i, t in enumerate(text_column(batch)):
            if texts and size + len(t) > budget:
                yield texts, rest
                texts, rest, size = [], {c: [] for c in columns}, 0
                groups += 1
                if groups % TRIM_EVERY == 0:
                    give_back()
            texts.append(t)
            for c in columns:
                rest[c].append(values[c][i])
            size += len(t)
    if texts:
        yield texts, rest
    texts, rest = [], {}
    batch = values = None
    give_back()
