"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarmill.llm import kernels as K

#: Words in a test string; an item with fewer is one test string.
WORDS = 13
#: Bytes of text that one search handles, and end positions in one of its lanes.
BATCH_BYTES, LANE = 4 << 20, 2048
#: Bytes of test strings in one search table at most; more of them are searched in several passes over the documents.
TABLE_BYTES = 64 << 20
#: Test strings are searched in classes by length, so that a short one doesn't shorten the skips for all: (least length, block).
CLASSES = ((32, 8), (12, 6), (3, 3))


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each row in lower case, with a space before and behind each, and where each row begins (one more than rows).

    Rows are apart by two spaces, so that no test string fits across them.
    """
    data, offsets = K.utf8(column)
    rows = len(offsets) - 1
    text = np.where(K.WORD_BYTE[data], K.lowered(data), np.uint8(32))
    out = np.full(len(data) + 2 * rows, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))] = text
    begin = offsets[:-1] + 2 * np.arange(rows)
    keep = out != 32
    keep[1:] |= keep[:-1].copy()
    keep[begin] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], count[np.append(begin, len(out))]


def test_strings(text: str | None, words: int = WORDS) -> list[bytes]:
    """The distinct test strings of a benchmark item: each run of `words` words, or all of fewer words; none without a word."""
    data, _ = normalised(pa.array([text], pa.string()))
    own = data.tobytes().split()
    n = min(words, len(own))
    return list(dict.fromkeys(b" " + b" ".join(own[i : i + n]) + b" " for i in range(len(own) - n + 1))) if n else []


class WuManber:
    """Shift tables and suffix buckets for test strings of at least `block` bytes.

    The window has the length of the shortest test string. The table holds
    for each hashed block how far the window may move without missing a test
    string; where that is 0, the bucket of the block's hash has the test
    strings whose window ends with such a block.
    """

    def __init__(self, patterns: list[bytes], block: int):
        self.patterns, self.block = patterns, block
        self.window = min(map(len, patterns))
        n = len(patterns)
        heads = np.frombuffer(b"".join(p[: self.window] for p in patterns), np.uint8).reshape(n, self.window)
        moves = self.window - block + 1
        self.bits = int(np.clip(np.ceil(np.log2(8 * n * moves)), 12, 24))
        self.shift = np.full(1 << self.bits, moves, np.int32)
        padded = np.zeros((n, self.window + 8), np.uint8)
        padded[:, 8:] = heads
        for end in range(block, self.window + 1):
            value = np.ascontiguousarray(padded[:, end : end + 8]).view("<u8").ravel()
            np.minimum.at(self.shift, self.hash(value), self.window - end)
        suffix = self.hash(np.ascontiguousarray(padded[:, self.window : self.window + 8]).view("<u8").ravel())
        order = np.argsort(suffix, kind="stable")
        self.bucket = order
        self.bucket_hash = suffix[order]
        size = min(8, self.window)
        self.prefix_bits = np.uint64(64 - 8 * size)
        first = np.zeros((n, 8), np.uint8)
        first[:, :size] = heads[:, :size]
        self.prefix = np.ascontiguousarray(first).view("<u8").ravel()

    def hash(self, value: np.ndarray) -> np.ndarray:
        """Of the last `block` of the eight bytes in each value."""
        with np.errstate(over="ignore"):
            x = (value >> np.uint64(64 - 8 * self.block)) * K.BASE
            return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, test string) of all occurrences. Lanes of the text advance together, each by its own shifts."""
        n = len(text)
        if n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.zeros(n + 16, np.uint8)
        padded[8 : 8 + n] = text
        eight = np.ndarray((n + 9,), "<u8", padded.tobytes(), strides=(1,))  # eight[i]: the eight bytes before position i of text
        at = np.arange(self.window, n + 1, LANE)  # end positions of the windows
        stop = np.minimum(at + LANE, n + 1)
        begins, strings = [], []
        while len(at):
            code = self.hash(eight[at])
            move = self.shift[code]
            stopped = np.flatnonzero(move == 0)
            if len(stopped):
                lo = np.searchsorted(self.bucket_hash, code[stopped], "left")
                size = np.searchsorted(self.bucket_hash, code[stopped], "right") - lo
                where = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                string = self.bucket[where]
                begin = np.repeat(at[stopped], size) - self.window
                head = eight[begin + 8] << self.prefix_bits >> self.prefix_bits if self.prefix_bits else eight[begin + 8]
                same = head == self.prefix[string]
                begins.append(begin[same])
                strings.append(string[same])
                move[stopped] = 1
            at = at + move
            on = at < stop
            at, stop = at[on], stop[on]
        begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        string = np.concatenate(strings) if strings else np.zeros(0, np.int64)
        whole = text.tobytes()
        hit = np.fromiter((whole.startswith(self.patterns[s], b) for b, s in zip(begin.tolist(), string.tolist())), bool, len(begin))
        return begin[hit], string[hit]


class Searcher:
    """Wu-Manber searches for the test strings of benchmark items, one for each class of lengths."""

    def __init__(self, strings: dict[bytes, list[int]]):
        self.items = list(strings.values())
        self.parts = []
        known = list(strings)
        left = np.arange(len(known))
        for least, block in CLASSES:
            mine = [i for i in left if len(known[i]) >= least]
            left = [i for i in left if len(known[i]) < least]
            if mine:
                self.parts.append((WuManber([known[i] for i in mine], block), np.array(mine)))

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, test string) of a text column, whole texts."""
        rows, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string())
        _, offsets = K.utf8(column)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
            text, first = normalised(column.slice(at, end - at))
            for part, number in self.parts:
                begin, string = part.search(text)
                if len(begin):
                    rows.append(np.searchsorted(first, begin, "right") - 1 + at)
                    strings.append(number[string])
            at = end
        row, string = np.concatenate(rows), np.concatenate(strings)
        both = np.unique(np.stack([row, string]), axis=1)
        return both[0], both[1]


def _searchers(benchmark: DataFrame, item: str, text: str, words: int) -> list:
    """Broadcast searchers; each has at most TABLE_BYTES of test strings."""
    out, strings, size = [], {}, 0
    sc = benchmark.sparkSession.sparkContext
    # A benchmark is a list of tests, small beside a corpus; its rows are streamed to the driver, and the tables bounded.
    for key, value in benchmark.select(item, text).where(F.col(item).isNotNull()).distinct().toLocalIterator():
        for x in test_strings(value, words):
            if x not in strings:
                size += len(x)
            own = strings.setdefault(x, [])
            if key not in own:
                own.append(key)
        if size > TABLE_BYTES:
            out.append(sc.broadcast(Searcher(strings)))
            strings, size = {}, 0
    return out + ([sc.broadcast(Searcher(strings))] if strings else [])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, item, n_strings): the benchmark items of which a document holds test strings, and how many distinct ones.

    A test string is a run of `words` words of an item, or the whole item if
    it is shorter; words are runs of ASCII letters and digits and of non-ASCII
    characters in lower case, so case, punctuation and white space make no
    difference. Each row of docs is searched by itself, so repeated rows give
    repeated results, and a null key gives a null; null and empty texts hold
    nothing. Items that repeat count once; items with a null id, a null text
    or no word hold no test string. Empty tables give an empty result.
    """
    schema = docs.select(F.col(key).alias("key")).schema.add(benchmark.schema[item])
    schema = schema.add("n_strings", "long")
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(shared):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for batch in batches:
                row, string = searcher.find(batch.column(1))
                pairs: dict[tuple[int, object], int] = {}
                for r, s in zip(row.tolist(), string.tolist()):
                    for i in searcher.items[s]:
                        pairs[r, i] = pairs.get((r, i), 0) + 1
                keys = batch.column(0).take(pa.array([r for r, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([i for _, i in pairs], item_type), pa.array(list(pairs.values()), pa.int64())], ["key", item, "n_strings"])

        return d.mapInArrow(found, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item].dataType)
    parts = [run(x) for x in _searchers(benchmark, item, item_text, words)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)  # the strings of one item are all in one table
    return out.toDF(key, item, "n_strings")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """docs without the rows that contaminated() finds, in its columns; all other rows stay as they are, null texts too.

    Rows pass through the search and aren't joined, so there is no shuffle.
    """
    at = docs.columns.index(text)

    def run(rows: DataFrame, shared) -> DataFrame:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, _ = shared.value.find(batch.column(at))
                mask = np.ones(batch.num_rows, bool)
                mask[row] = False
                yield batch.filter(pa.array(mask))

        return rows.mapInArrow(kept, docs.schema)

    for shared in _searchers(benchmark, item, item_text, words):
        docs = run(docs, shared)
    return docs


#: DuckDB SQL for contaminated(documents, benchmark).
ORACLE_SQL = rf"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10ffff}}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10ffff}}]+') AS w FROM benchmark),
bs AS (
  SELECT item_id, least({WORDS}, len(w)) AS n, array_to_string(list_slice(w, i, i + least({WORDS}, len(w)) - 1), ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least({WORDS}, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bs),
ds AS (
  SELECT rid, doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT rid, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n))
SELECT doc_id, item_id, CAST(count(DISTINCT ds.s) AS BIGINT) AS n_strings
FROM ds JOIN bs ON ds.n = bs.n AND ds.s = bs.s GROUP BY rid, doc_id, item_id
"""
