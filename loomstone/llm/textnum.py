"""Words and shingles of whole Arrow batches as 64-bit hashes, computed on the UTF-8 bytes with numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over a fixed
random table of bytes, read off prefix sums, so that a batch costs a few passes over its bytes and no
Python work a word. A-Z hash as a-z when `lower` is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if lower:
        table[65:91] = table[97:123]
    return table


_TABLES = {lower: _table(lower) for lower in (False, True)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end of each word, and rows+1 offsets into them. inner: bytes that belong to words, if other than no white space; or numbers of kinds of bytes, 0 for none, and a word is of one kind."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = (~_SPACE if inner is None else inner)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    turn = (kind[1:] != kind[:-1]) | edge[1:-1]
    first, last = kind > 0, kind > 0
    first[1:] &= turn
    last[:-1] &= turn
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(_TABLES[lower][data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return h, start, end, np.searchsorted(start, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k consecutive words; of fewer words, one of the whole sequence; without words, none."""
    h, _, _, at = words(data, offsets)
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        rolled = rolled * U64(0xFF51AFD7ED558CCD) + h[j : j + len(rolled)]
    rolled = mix(rolled + U64(k))
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= k:
            x = np.sort(rolled[s : e - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif e > s:
            x = U64(0)
            with np.errstate(over="ignore"):
                for w in h[s:e]:
                    x = x * U64(0xFF51AFD7ED558CCD) + w
                out.append(mix(np.array([x + U64(e - s)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
