"""Word kernels shared by the text operators: Arrow string column in, numpy arrays out.

A word is ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes (every separator is one ASCII
byte, so bytes and characters split alike).  Words are represented by 64-bit hashes
that depend on nothing but the word's bytes; arithmetic is modulo 2**64 throughout.
Working memory is bounded by ``GROUP_BYTES`` of text, or by one document where a single
document is longer than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
SEGMENT = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xD6E8FEB86659FD93 | 1}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) for i < n; tables grow by doubling and are kept per process."""
    have = _POWERS.get((kind, inverse))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        base = _BASE[kind] if not inverse else pow(_BASE[kind], -1, 2**64)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[kind, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def doc_groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte range of each word, and the first word of each document."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data[lo:hi]]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[(offsets > lo) & (offsets < hi)] - lo
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin) + lo, np.flatnonzero(end) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > SEGMENT:  # one enormous word
            raw = data[starts[i] : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b((LOWER[raw] if lower else raw).tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        raw = data[lo:hi]
        values = _BYTE[LOWER[raw] if lower else raw]
        values *= powers("byte", hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * powers("byte", hi - lo, inverse=True)[a] + (b - a).astype(np.uint64))
        i = j
    return out


def prefix_sums(hashes: np.ndarray, kind: str) -> np.ndarray:
    """S with span_hash(S, p, n) the hash of words p .. p+n-1, wherever they stand."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(kind, len(hashes)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, at: np.ndarray, n: int | np.ndarray, kind: str) -> np.ndarray:
    return mix((sums[at + n] - sums[at]) * powers(kind, len(sums), inverse=True)[at])


def windows_within(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, documents) of the windows of ``size`` words that lie within one document."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - first[:-1], counts), docs


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): sorted distinct shingle hashes of each document.

    A document of fewer than ``size`` words has its whole sequence as its one shingle;
    one without words has none.
    """
    sums = prefix_sums(hashes, "word")
    at, docs = windows_within(first, size)
    values = span_hash(sums, at, size, "word")
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        whole = mix(span_hash(sums, first[short], words[short], "word") ^ (np.uint64(0x5851F42D4C957F2D) * words[short].astype(np.uint64)))
        values, docs = np.concatenate([values, whole]), np.concatenate([docs, short])
    order = np.lexsort((values, docs)) if len(values) else np.zeros(0, np.int64)
    values, docs = values[order], docs[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[keep], docs[keep]
    return values, np.searchsorted(docs, np.arange(len(words) + 1)).astype(np.int64)


def text_groups(column: pa.Array, lower: bool = False, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, data, starts, ends, first, hashes) for each group of documents i .. j-1 of a column."""
    data, offsets = buffers(column)
    for i, j in doc_groups(offsets, most):
        starts, ends, first = word_bounds(data, offsets[i : j + 1])
        yield i, j, data, starts, ends, first, hash_words(data, starts, ends, lower)
