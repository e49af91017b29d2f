"""Token counts and ids by the whole-token shortcut."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Ranks of a byte-level BPE vocabulary, one base64 token and its rank a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's text is cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker remembers; beyond that it forgets them all, which costs time only.
REMEMBERED = 300_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by byte-pair merges alone: the pair of least rank first, the leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


class Cutter:
    """Cuts texts into pre-tokens; texts in Latin-1 by a pattern of plain character classes, which is twice as fast."""

    def __init__(self):
        import re

        import regex

        spaced = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.any = regex.compile(spaced).findall
        kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(p, chr(c))) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\p{White_Space}"))}
        latin = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(**kinds)
        self.latin = re.compile(latin).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)


def prove(ranks: dict[bytes, int]) -> dict[str, int]:
    """The vocabulary strings that encode alone as their one token.

    A string is proven if it is UTF-8, if the pre-tokeniser leaves it in one
    piece, and if the merges by rank, from single bytes, end with the string
    as a whole. A pre-token that is equal to such a string is that token
    wherever it stands, for merges don't look beyond a pre-token.
    """
    cut, out = Cutter(), {}
    for token, rank in ranks.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if cut(text) == [text] and merge(token, ranks) == [rank]:
            out[text] = rank
    return out


class Vocabulary:
    """Ranks and proven strings; made once on the driver and sent to the workers."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
        self.whole = prove(self.ranks)
        self._tools = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def tools(self) -> tuple:
        """(cutter, lookup of counts, lookup of ids as bytes), made once in a worker."""
        if self._tools is None:
            import struct

            import tiktoken

            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
            wide = "H" if max(self.ranks.values()) < 0xFFFF else "I"

            class Counts(dict):
                def __missing__(inner, piece: str) -> int:
                    n = inner[piece] = len(encode(piece))
                    return n

            class Ids(dict):
                def __missing__(inner, piece: str) -> bytes:
                    ids = encode(piece)
                    x = inner[piece] = struct.pack(f"<{len(ids)}{wide}", *ids)
                    return x

            self._tools = Cutter(), Counts, {k: 1 for k in self.whole}, Ids, {k: struct.pack(f"<{wide}", v) for k, v in self.whole.items()}
        return self._tools

    def counter(self):
        """A function from a text to (tokens, of these by the shortcut)."""
        cut, kind, start, _, _ = self.tools()
        whole, known = self.whole, kind(start)

        def count(text: str) -> tuple[int, int]:
            pieces = cut(text)
            n = sum(map(known.__getitem__, pieces))
            if len(known) > REMEMBERED:
                known.clear()
                known.update(start)
            return n, sum(map(whole.__contains__, pieces))

        return count

    def encoder(self):
        """A function from a text to its ids as little-endian bytes."""
        cut, _, _, kind, start = self.tools()
        known = kind(start)

        def encode(text: str) -> bytes:
            out = b"".join(map(known.__getitem__, cut(text)))
            if len(known) > REMEMBERED:
                known.clear()
                known.update(start)
            return out

        return encode


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str = TOKENIZER) -> Vocabulary:
    """The vocabulary of a file, proven once in a driver."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens, n_whole) for each row: its tokens, and how many of these the shortcut gave.

    Whole texts are counted, special tokens not among them. A null text has
    null counts, an empty one 0. Repeated rows stay repeated; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value.counter()
        for batch in batches:
            both = [count(x.as_py()) if x.is_valid else (None, None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64())], ["key", "n_tokens", "n_whole"])

    schema = d.select("key").schema.add("n_tokens", "long").add("n_whole", "long")
    return d.mapInArrow(run, schema).withColumnRenamed("key", key)
