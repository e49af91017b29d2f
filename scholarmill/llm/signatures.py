"""SimHash signatures of texts and of lines, and exact searches among signatures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from scholarmill.llm import kernels as K

#: Words of at least so many bytes are features; a text with fewer than three of these uses all of its words.
MIN_BYTES = 4
#: Rows that are hashed at once; small enough for the processor's cache.
CHUNK = 512
#: Lines of at most SHORT bytes of words and single spaces have their letters as features; those of at least BOTH have their words; near lines have one kind in common.
SHORT, BOTH = 160, 128


def _content(start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    keep = (end - start) >= MIN_BYTES
    count = np.concatenate([[0], np.cumsum(keep)])[first]
    return keep | np.repeat(np.diff(count) < 3, np.diff(first))


def _two(features: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits as two longs."""
    with np.errstate(over="ignore"):
        again = K.mix(features + np.uint64(0x632BE59BD9B4E019))
    return K.simhash(features, offsets), K.simhash(again, offsets)


def text_signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, number of words): the 128-bit SimHash over the set of words of each text."""
    out = []
    for at in range(0, len(column), CHUNK):
        data, offsets = K.utf8(column.slice(at, CHUNK))
        data = K.lowered(data)
        start, end, first = K.words(data, offsets)
        hashes = K.span_hashes(K.BYTE_CODE[data], start, end)
        keep = _content(start, end, first)
        row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
        key = np.unique((row[keep] << np.uint64(52)) | (hashes[keep] >> np.uint64(12)))
        features = K.mix(key & np.uint64((1 << 52) - 1))
        ends = np.searchsorted(key >> np.uint64(52), np.arange(len(first), dtype=np.uint64))
        out.append((*_two(features, ends), np.diff(first)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets, bytes): the set of runs of two and of three bytes of each line's words with single spaces between and around, none for lines of more than SHORT bytes."""
    bytes_ = np.diff(np.concatenate([[0], np.cumsum(end - start + 1)])[first]) - 1
    words = np.where(bytes_ <= SHORT, np.diff(first), 0)
    some = np.repeat(bytes_ <= SHORT, np.diff(first))
    start, length = start[some], (end - start)[some]
    at = np.concatenate([[0], np.cumsum(length + 1)])
    before = np.repeat(np.cumsum(length) - length, length)
    i = np.arange(len(before))
    text = np.full(at[-1] + 2, 32, np.uint64)
    text[1 + np.repeat(at[:-1], length) + i - before] = data[np.repeat(start, length) + i - before]
    size = np.diff(at[np.concatenate([[0], np.cumsum(words)])])
    keep = np.ones(at[-1], bool)
    keep[np.cumsum(size)[size > 0] - 1] = False
    row = np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(24)
    two = text[:-2] << np.uint64(8) | text[1:-1]
    key = np.unique(np.concatenate([row | two, (row | two << np.uint64(8) | text[2:])[keep]]))
    offsets = np.searchsorted(key >> np.uint64(24), np.arange(len(first), dtype=np.uint64))
    return K.mix(key & np.uint64((1 << 24) - 1)), offsets, bytes_


#: Kinds of characters that counts() tells apart, by their first byte; the last one is the space.
KINDS = 16
_KIND = np.full(256, KINDS, np.int64)
_KIND[:128], _KIND[192:] = np.arange(128) * 7 % (KINDS - 1), np.arange(64) % (KINDS - 1)
_KIND[32] = KINDS - 1


def counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each kind a line of words and single spaces has, up to 255, as bytes of two longs."""
    n, words = len(first) - 1, np.diff(first)
    length = end - start
    row = np.repeat(np.repeat(np.arange(n), words), length)
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    kind = _KIND[data[at]]
    lead = kind < KINDS
    out = np.bincount(row[lead] * KINDS + kind[lead], minlength=n * KINDS).reshape(n, KINDS)
    out[:, -1] = np.maximum(words - 1, 0)
    return tuple(np.ascontiguousarray(np.minimum(out, 255).astype(np.uint8)).view(np.uint64).T)


def may_be_similar(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of counts() may belong to lines with at most `share` of the longer one's characters edited: an edit takes away one character at most and adds one at most. Holds where no count is 255."""
    x, y = (np.ascontiguousarray(z).view(np.uint8).reshape(-1, KINDS).astype(np.int16) for z in (a, b))
    diff = x - y
    more, less = np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1)
    return np.maximum(more, less) <= share * np.maximum(x.sum(1), y.sum(1)) + 1e-9


def line_signatures(column: pa.Array) -> dict[str, np.ndarray]:
    """For each line with a word: row, its number in the row, 128 bits of hash of its words (h0, h1), and its SimHashes: w0 and w1 by words, c0 and c1 by letters.

    The normalised form of a line is its words in lower case, so white space
    and punctuation make no difference. Letters are runs of two and three
    bytes, as an edit changes much of a short line's words. k0 and k1 are counts(). size is in bytes; has_words
    and has_letters tell which a line has: words from BOTH bytes on, letters up to
    SHORT bytes, and both in between.
    """
    out = []
    for at in range(0, len(column), CHUNK):
        data, offsets = K.utf8(column.slice(at, CHUNK))
        breaks = np.flatnonzero(data == 10)
        row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        line_row = np.sort(np.concatenate([np.arange(len(offsets) - 1), row_of_break]))
        number = np.arange(len(begin)) - np.searchsorted(line_row, line_row)
        data = K.lowered(data)
        start, end, first = K.words(data, np.append(begin, len(data)))
        hashes = K.span_hashes(K.BYTE_CODE[data], start, end)
        h0 = K.span_hashes(hashes, first[:-1], first[1:])
        with np.errstate(over="ignore"):
            h1 = K.span_hashes(K.mix(hashes + np.uint64(0xD6E8FEB86659FD93)), first[:-1], first[1:])
        grams, ends, size = _letters(data, start, end, first)
        c0, c1 = _two(grams, ends)
        some = np.diff(first) > 0
        long = some & (size >= BOTH)
        keep = _content(start, end, first) & np.repeat(long, np.diff(first))
        w0, w1 = _two(hashes[keep], np.concatenate([[0], np.cumsum(keep)])[first])
        out.append([x[some] for x in (line_row + at, number, h0, h1, w0, w1, c0, c1, *counts(data, start, end, first), size, long, size <= SHORT)])
    names = ("row", "number", "h0", "h1", "w0", "w1", "c0", "c1", "k0", "k1", "size", "has_words", "has_letters")
    return dict(zip(names, (np.concatenate(x) for x in zip(*out)))) if out else {n: np.zeros(0, np.int64) for n in names}


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row << 44 | word hash) of a column, and where each row starts."""
    data, offsets = K.utf8(column)
    data = K.lowered(data)
    start, end, first = K.words(data, offsets)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = np.unique((row << np.uint64(44)) | (K.span_hashes(K.BYTE_CODE[data], start, end) >> np.uint64(20)))
    return key, np.searchsorted(key >> np.uint64(44), np.arange(len(first), dtype=np.uint64))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of [n, 2] signatures."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def near_among(sig: np.ndarray, near: int, share: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some signatures lie at most `near` from one, for reachable(); those with counts (k0, k1) behind the bits must allow for similarity too."""

    def linked(at: int, them: np.ndarray) -> np.ndarray:
        hit = distance(sig[them], sig[at]) <= near
        if sig.shape[1] > 2 and hit.any():
            hit[hit] = may_be_similar(sig[them[hit], 2:], sig[at : at + 1, 2:], share)
        return hit

    return linked


def reachable(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of a graph of n vertices, as (parent, child); near(vertex, candidates) tells which of these it is linked to.

    Breadth first: each vertex is compared with those not yet reached, which
    a dense group empties at once, so that n copies cost about n comparisons.
    """
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop(0)
            hit = near(at, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                for child in found:
                    yield int(at), int(child)


#: Nodes of at most so many signatures are compared by a distance matrix, larger ones breadth first.
MATRIX = 2048


def node_edges(ids: np.ndarray, sig: np.ndarray, near: int, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all signatures that lie at most `near` apart, each directly or through others.

    Exact: every pair counts. Returns all near pairs, or a spanning forest of
    their graph where there are more than eight a vertex.
    """
    n = len(ids)
    if n <= MATRIX:
        s0, s1 = np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1])
        a, b, found = [], [], 0
        for at in range(0, n - 1, 64):
            rows = min(64, n - 1 - at)
            apart = np.bitwise_count(s0[at : at + rows, None] ^ s0[at + 1 :]) + np.bitwise_count(s1[at : at + rows, None] ^ s1[at + 1 :])
            hit = np.flatnonzero(apart <= near)
            x, y = hit // (n - 1 - at), hit % (n - 1 - at)
            x, y = x[y >= x] + at, y[y >= x] + at + 1
            if sig.shape[1] > 2 and len(x):
                both = may_be_similar(sig[x, 2:], sig[y, 2:], share)
                x, y = x[both], y[both]
            a.append(x)
            b.append(y)
            found += len(x)
            if found > 8 * n:
                break
        else:
            a, b = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))
            return ids[a], ids[b]
    pairs = np.array(list(reachable(n, near_among(sig, near, share))), np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def collapsed(ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal signatures, the least id stands for all: (ids, signatures) that are left, by id, and the edges to them."""
    order = np.lexsort((ids, *sig.T[::-1]))
    ids, sig = ids[order], sig[order]
    new = np.ones(len(ids), bool)
    new[1:] = (sig[1:] != sig[:-1]).any(1)
    lead = np.flatnonzero(new)
    head = ids[lead][np.cumsum(new) - 1]
    a, b = head[~new], ids[~new]
    lead = lead[np.argsort(ids[lead], kind="stable")]
    return ids[lead], sig[lead], a, b


def agree(width: int, apart: int) -> float:
    """The chance that two signatures that differ in `apart` of 128 bits agree on `width` bits drawn at random."""
    return float(np.prod(np.clip(1 - apart / (128 - np.arange(width)), 0, 1)))


def draws(chance: float, target: float) -> int:
    """How often something of that chance must be tried to happen with the target chance."""
    return max(1, math.ceil(math.log(1 - target) / math.log1p(-chance))) if chance < 1 else 1


#: Signatures of a group that one task searches, on average at most, and the chance that it finds a near pair of a group.
GROUP, LOCAL = 1 << 18, 0.6


class Plan(NamedTuple):
    """Signatures meet in `tables` groupings, each by `width` bits; a group's own search finds a near pair with the chance `local`."""

    width: int
    tables: int
    local: float

    def recall(self, apart: int, near: int) -> float:
        """The chance at least that a pair `apart` <= near bits apart is found; its group's search is planned for pairs that are `near` apart."""
        return 1 - (1 - agree(self.width, apart) * self.local) ** self.tables


def plan(n: int, near: int, target: float, group: int = GROUP) -> Plan:
    """For n signatures: groups have `group` members at most on average, and there are as many tables as find a pair that is `near` bits apart with the target chance; nearer ones are found more often."""
    width = max(0, math.ceil(math.log2(max(1, n / group))))
    if not width:
        return Plan(0, 1, target)
    return Plan(width, draws(agree(width, near) * LOCAL, target), LOCAL)


def orders(n: int, width: int, seed: int) -> np.ndarray:
    """[n, 128] orders of the bits, whose first `width` are a block; the blocks of one permutation are disjoint, so that a pair with fewer differences than blocks agrees on one of them."""
    rng, per, out = np.random.default_rng(seed), max(1, 128 // max(1, width)), []
    while len(out) < n:
        order = rng.permutation(128)
        out += [np.roll(order, -i * width) for i in range(per)]
    return np.array(out[:n])


def bit_rows(sig: np.ndarray) -> np.ndarray:
    """[128, n] bits of [n, 2] signatures."""
    return np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), 16), axis=1, bitorder="little").T)


def prefix(rows: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bits, at most 64, of each signature in an order, the first one highest."""
    out = np.zeros(rows.shape[1], np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64)
    for i in order[:width]:
        out <<= 1
        out |= rows[i]
    return out


#: Runs of more signatures than this are searched as nodes, shorter ones by shifting.
RUN = 64
#: Work of a pass for each signature, and for each pair of a run, in parts of a microsecond.
PASS, PAIR = 0.15, 0.015


def run_edges(ids: np.ndarray, sig: np.ndarray, value: np.ndarray, near: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges as of node_edges() within each run of signatures with equal block value."""
    order = np.argsort(value, kind="stable")
    value, sig = value[order], sig[order]
    s0, s1 = np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1])
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    length = np.diff(np.append(starts, len(value)))
    a, b = [order[:0]], [order[:0]]
    for s, n in zip(starts[length > RUN].tolist(), length[length > RUN].tolist()):
        x, y = node_edges(order[s : s + n], sig[s : s + n], near, share)
        a.append(x)
        b.append(y)
    # How many members of its run come behind a member; those of long runs are done.
    behind = np.repeat(starts + length, length) - np.arange(len(value)) - 1
    behind[np.repeat(length > RUN, length)] = 0
    at, k = np.flatnonzero(behind), 1
    while len(at):
        other = at + k
        apart = np.bitwise_count(s0.take(at) ^ s0.take(other)) + np.bitwise_count(s1.take(at) ^ s1.take(other))
        hit = np.flatnonzero(apart <= near)
        if sig.shape[1] > 2 and len(hit):
            hit = hit[may_be_similar(sig[at[hit], 2:], sig[other[hit], 2:], share)]
        if len(hit):
            a.append(order[at[hit]])
            b.append(order[other[hit]])
        k += 1
        at = at[behind.take(at) >= k]
    return ids[np.concatenate(a)], ids[np.concatenate(b)]


def block_width(rows: np.ndarray, order: np.ndarray, near: int, target: float) -> int:
    """The width of the blocks with which a group is searched with least work: narrow blocks take fewer passes, but have longer runs. The runs are those of one order, as bits may be unlike."""
    n = rows.shape[1]
    least, best = math.inf, 1
    for width in range(max(1, math.ceil(math.log2(n / 32))), 33):
        value = prefix(rows, order, width)
        length = np.bincount(value) if width <= 20 else np.unique(value, return_counts=True)[1]
        work = draws(agree(width, near), target) * (n * PASS + float((length * (length - 1.0)).sum() / 2) * PAIR)
        if work > 1.2 * least:
            break
        if work < least:
            least, best = work, width
    return best


def group_edges(ids: np.ndarray, sig: np.ndarray, near: int, target: float, seed: int, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a group: each pair that is `near` bits apart is found with the target chance, nearer ones more often, or connected through others; all in a group of up to MATRIX. Signatures may have counts() behind their bits, which pairs must pass too."""
    ids, sig, *same = collapsed(ids, sig)
    if len(ids) <= MATRIX:
        x, y = node_edges(ids, sig, near, share)
        return np.concatenate([same[0], x]), np.concatenate([same[1], y])
    rows, edges = bit_rows(sig[:, :2]), [np.stack(same, 1)]
    width = block_width(rows, orders(1, 1, seed)[0], near, target)
    for order in orders(draws(agree(width, near), target), width, seed):
        edges.append(np.stack(run_edges(ids, sig, prefix(rows, order, width), near, share), 1))
    return tuple(np.unique(np.concatenate(edges), axis=0).T)
