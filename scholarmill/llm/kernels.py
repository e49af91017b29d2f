"""Vectorised text kernels shared by the training-data operators.

Everything here works on whole Arrow string columns at once: the UTF-8 bytes
of a batch are one numpy array, words are found by a byte table, and word and
shingle hashes are differences of one prefix sum, so no Python loop runs over
words or documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; sums of these times powers of BASE hash byte strings.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of words: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Spreads the bits of a byte over the bytes of a word, so that adding words counts eight bits at once.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8, in place of length."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] = data[after] + 32
    return out


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE), dtype=np.uint64)])
            _INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE_INV), dtype=np.uint64)])
    return _POWERS[:n], _INVERSES[:n]


_INVERSES = np.ones(1, np.uint64)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, equal for equal content wherever it stands."""
    power, inverse = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1], dtype=np.uint64)])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row (one more than rows).

    No word crosses a row's end.
    """
    inside = WORD_BYTE[data]
    before = np.concatenate([[False], inside[:-1]])
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words and the number of the first one of each row.

    A row with fewer words, but at least one, has one shingle of all of them.
    """
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate([[0], np.cumsum(n)])
    position = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], n)
    last = np.repeat(first[1:], n)
    total = np.zeros(len(position), np.uint64)
    padded = np.concatenate([word_hash, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(width):
            at = position + i
            total = total * BASE + np.where(at < last, padded[at], np.uint64(0))
    return mix(total), offsets


def bit_sums(features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, how many of its 64-bit features have each bit set: int64 [rows, 64].

    Eight counters share a machine word: features are added in runs of at most
    255, whose byte-wide counters cannot overflow, and then widened.
    """
    rows = len(offsets) - 1
    count = np.diff(offsets)
    pieces = -(-count // 255)
    piece_row = np.repeat(np.arange(rows), pieces)
    out = np.zeros((rows, 64), np.int64)
    if len(piece_row) == 0:
        return out
    within = np.arange(len(piece_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(offsets[:-1], pieces) + within * 255
    as_bytes = features.view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(pieces)
    starts = (np.cumsum(pieces) - pieces)[full]
    for byte in range(8):
        lanes = np.add.reduceat(SPREAD[as_bytes[:, byte]], begin)
        wide = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, byte * 8 : byte * 8 + 8] = np.add.reduceat(wide, starts, axis=0)
    return out


def simhash(features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each row's features; 0 for a row without any. A tied bit is 0."""
    sums = bit_sums(features, offsets)
    bits = sums * 2 > np.diff(offsets)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)
