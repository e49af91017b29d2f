"""Token ids packed into fixed-width sequences by best-fit decreasing."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarmill.llm import tokens as T

#: Ids in a sequence; ids that a task packs at once; the id that ends each document and fills the sequence up.
WIDTH, BLOCK, END = 2048, 8_000_000, 50256


class Capacities:
    """Open bins by the room left in them: a segment tree over room, whose nodes count the bins below."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the bin with the least room that is at least `size`: (room, number)."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not count[node]:
                    node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """(bin of each size, number of bins): longest first, each into the fullest bin that has room; ties by position."""
    out = np.zeros(len(sizes), np.int64)
    open_bins, n = Capacities(width), 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        found = open_bins.take(size) if size < width else None
        if found is None:
            room, number, n = width, n, n + 1
        else:
            room, number = found
        out[i] = number
        if room > size:
            open_bins.put(room - size, number)
    return out, n


def _packed(ids: list[bytes], keys: pa.Array, width: int, first: int, end: int) -> pa.RecordBatch:
    """A block of documents as sequences; first is the number of the first one."""
    size = np.array([len(x) // 2 for x in ids], np.int64)
    pieces = np.maximum(1, -(-size // width))
    doc = np.repeat(np.arange(len(ids)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * width
    length = np.minimum(width, size[doc] - start)
    where, n = best_fit_decreasing(length, width)
    order = np.lexsort((np.arange(len(doc)), -length, where))
    doc, number, start, length, where = (x[order] for x in (doc, number, start, length, where))
    head = np.searchsorted(where, np.arange(n + 1))
    total = np.concatenate([[0], np.cumsum(length)])
    begin = total[:-1] - total[head[where]] + where * width
    matrix = np.full(n * width, end, "<u2")
    position = np.zeros(n * width, "<u2")
    count = np.arange(width, dtype="<u2")
    flat = [np.frombuffer(x, "<u2") for x in ids]
    for d, s, m, b in zip(doc.tolist(), start.tolist(), length.tolist(), begin.tolist()):
        matrix[b : b + m] = flat[d][s : s + m]
        position[b : b + m] = count[:m]
    cumulative = np.insert(total[1:] - total[head[where]], head[:-1], 0).astype(np.int32)
    lists = pa.array(head, pa.int32())
    rows_of = keys.take(pa.array(doc))
    offsets = pa.array((np.arange(n + 1) * width * 2).astype(np.int32)).buffers()[1]
    binary = lambda x: pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(n) + first, pa.int64()),
            pa.array(total[head[1:]] - total[head[:-1]], pa.int32()),
            pa.ListArray.from_arrays(lists, rows_of),
            pa.ListArray.from_arrays(lists, pa.array(number, pa.int32())),
            pa.ListArray.from_arrays(pa.array(head + np.arange(n + 1), pa.int32()), pa.array(cumulative)),
            binary(matrix),
            binary(position),
        ],
        ["pack_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"],
    )


def pack_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, block: int = BLOCK, path: str = T.TOKENIZER, end: int = END) -> DataFrame:
    """Sequences (pack_id, n_tokens, doc_ids, pieces, cu_seqlens, input_ids, position_ids) of `width` ids.

    Each row of docs, its ids and the end id, is cut into pieces of `width`
    ids and one shorter piece, so that nothing is lost; piece i begins at id
    i * width. Pieces are packed by best-fit decreasing, those of about
    `block` ids at once in each task: no shuffle, and as many sequences in
    part empty as there are blocks. input_ids and position_ids are rows of a
    matrix of little-endian 16-bit integers; positions begin again at 0 with
    each piece, cu_seqlens has where the pieces begin and end, and the rest is
    filled with the end id at position 0. pack_id has the task in its high
    bits. An empty text has its end id; null texts have no ids and are left
    out; repeated rows stay repeated, and a null key is a null in doc_ids. An
    empty table gives an empty result. width is less than 65536 and the
    vocabulary has fewer than 65535 ids.
    """
    vocabulary = T.vocabulary(path)
    if max(width, end, max(vocabulary.ranks.values())) >= 0xFFFF:
        raise ValueError("ids and positions must fit in 16 bits")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("task"))
    stop = int(end).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoder()
        keys, ids, held, number = [], [], 0, None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() << 40
            begin = 0
            for i, x in enumerate(batch.column(1)):
                ids.append(encode(x.as_py()) + stop)
                held += len(ids[-1]) // 2
                if held >= block:
                    keys.append(batch.column(0).slice(begin, i + 1 - begin))
                    out = _packed(ids, pa.concat_arrays(keys), width, number, end)
                    yield out
                    number += out.num_rows
                    keys, ids, held, begin = [], [], 0, i + 1
            keys.append(batch.column(0).slice(begin))
        if ids:
            yield _packed(ids, pa.concat_arrays(keys), width, number, end)

    kind = docs.select(key).schema[0].dataType.simpleString()
    return d.mapInArrow(run, f"pack_id long, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Write sequences as flat binary files and return a manifest (file, n_rows), one row a task.

    folder is on a file system that all executors mount. Each task writes
    <task>.ids and <task>.positions, matrices of 16-bit integers, and
    <task>.seqlens, the cumulative lengths of each row as 32-bit integers, with
    <task>.rows, how many of these each row has. Files appear under their names
    only when whole, and a repeated task writes the same again.
    """
    os.makedirs(folder, exist_ok=True)
    p = packed.select(F.spark_partition_id().alias("task"), "input_ids", "position_ids", "cu_seqlens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, n, task, own = None, 0, 0, uuid.uuid4().hex
        names = ("ids", "positions", "seqlens", "rows")
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0)[0].as_py()
            files = files or [open(os.path.join(folder, f".{own}.{x}"), "wb") for x in names]
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                files[0].write(x)
                files[1].write(y)
            files[2].write(batch.column(3).flatten().to_numpy().astype("<i4").tobytes())
            files[3].write(np.diff(batch.column(3).offsets.to_numpy()).astype("<i4").tobytes())
            n += batch.num_rows
        if files:
            for f, x in zip(files, names):
                f.close()
                os.replace(f.name, os.path.join(folder, f"part-{task:06d}.{x}"))
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}"]), pa.array([n], pa.int64())], ["file", "n_rows"])

    return p.mapInArrow(run, "file string, n_rows long")
