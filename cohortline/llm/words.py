"""Words, word hashes and shingles of many texts at once, as numpy arrays.

A word is a run of bytes other than space and tab to carriage return (0x20, 0x09-0x0D). All hashes are 64 bits, depend on content alone
and are the same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time. One longer text is still taken whole.
CHUNK_BYTES = 1_000_000
#: Bytes of text that a task works on between two outputs.
SLICE_BYTES = 8_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur3's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n."""
    base = int(_EVEN)
    back = pow(base, -1, 1 << 64)
    out = []
    for b in (base, back):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]; equal bytes give equal hashes wherever they lie."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lists of about `limit` bytes, each with the position of its first text."""
    first, part, size = 0, [], 0
    for i, x in enumerate(texts):
        part.append(x)
        size += len(x) + 1
        if size >= limit:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` bytes of a column, so that memory doesn't depend on the length of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else []
        for a, b in zip(edge[:-1], edge[1:]):
            yield batch.slice(int(a), int(b - a))


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 of each text; a missing text is empty."""
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


class Words:
    """The words of a list of texts. `first[i]:first[i + 1]` are the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False, letters: bool = False):
        """`letters`: words are runs of ASCII letters and of bytes from 0x80 on instead."""
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.text_end = self.text_start + lengths
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        if letters:
            blank = ~((self.data >= 128) | (((self.data | 32) >= 97) & ((self.data | 32) <= 122)))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.concatenate((np.searchsorted(self.starts, self.text_start), [len(self.starts)]))

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.text_end] - total[self.text_start]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n successive values, as many as there are full runs."""
    out = values[: max(0, len(values) - n + 1)].copy()
    for i in range(1, n):
        out = mix(out * _EVEN + values[i : i + len(out)])
    return mix(out + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word runs, ASCII letters in lower case.

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    for _, part in chunks(texts):
        words = Words(part, lower=True)
        hashes = words.hashes()
        runs = run_hashes(hashes, n)
        for i in range(len(part)):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield run_hashes(hashes[a:b], int(b - a))
            else:
                yield runs[:0]


def set_key(values: np.ndarray) -> int:
    """63 bits that stand for a whole sorted set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little") >> 1
