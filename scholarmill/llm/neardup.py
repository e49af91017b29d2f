"""Near-duplicate documents: SimHash signatures in an LSH forest, verified by the overlap of word sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarmill.llm import signatures as S
from scholarmill.llm.candidates import candidate_edges, verified
from scholarmill.operators.components import connected_components
from scholarmill.session import cut_lineage

#: Documents are near if their signatures differ in at most so many of 128 bits and the Jaccard similarity of their word sets is at least MIN_JACCARD.
NEAR, MIN_JACCARD = 28, 0.75
#: The chance at least that a pair of signatures that is NEAR apart is compared; nearer ones are compared more often, at any number of documents.
RECALL = 0.9
#: Signatures in a node that are compared at once, and bits beyond those of nodes of that size that a dense branch is descended at most.
NODE, DEEPER = 256, 3
#: A group's trees are searched by one task for so many of its signatures.
PART = 1 << 15
#: Bytes of text of a candidate group that are checked at once at most.
PART_BYTES = 32_000_000


def node_ranges(path: np.ndarray, deepest: int) -> list[tuple[int, int]]:
    """Nodes (begin, end) of a tree over sorted paths of 64 bits: the branches are descended while they hold more than NODE, down to `deepest` bits."""
    out, stack = [], [(0, len(path), 0)]
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= NODE or d >= deepest:
            out.append((lo, hi))
            continue
        mid = lo + int(np.searchsorted((path[lo:hi] >> np.uint64(63 - d)) & np.uint64(1), 1))
        stack += [(lo, mid, d + 1), (mid, hi, d + 1)]
    return out


def forest_edges(ids: np.ndarray, sig: np.ndarray, near: int, target: float, seed, share: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a group by an LSH forest: each pair that is `near` bits apart is found with the target chance, nearer ones more often, or connected through others.

    Each tree has the signatures by the path of their bits in an order of its
    own. A search climbs from long prefixes to shorter ones: as far as a node
    holds NODE signatures in sparse regions, and in dense ones as far as the
    target asks, for there are as many trees as reach it at the greatest
    depth. Whatever such a node holds is compared. share is (number, of how
    many): of the trees, that one and each so many behind it are searched, and
    all shares together find what one search finds.
    """
    number, shares = share
    ids, sig, *same = S.collapsed(ids, sig)
    if number:
        same = [x[:0] for x in same]
    if len(ids) <= NODE:
        if number:
            return ids[:0], ids[:0]
        x, y = S.node_edges(ids, sig, near)
        return np.concatenate([same[0], x]), np.concatenate([same[1], y])
    deepest = min(60, math.ceil(math.log2(len(ids) / NODE)) + DEEPER)
    rows, edges = S.bit_rows(sig), [np.stack(same, 1)]
    rng = np.random.default_rng(seed)
    trees = [rng.permutation(128) for _ in range(S.draws(S.agree(deepest, near), target))]
    for bits in trees[number::shares]:
        path = S.prefix(rows, bits, 64)
        order = np.argsort(path, kind="stable")
        for lo, hi in node_ranges(path[order], deepest):
            own = order[lo:hi]
            edges.append(np.stack(S.node_edges(ids[own], sig[own], near), 1))
    return tuple(np.unique(np.concatenate(edges), axis=0).T)


def near_texts(rows: pa.Table, near: int, least: float) -> np.ndarray:
    """For each document of a candidate group, the position of the first one that it is connected with."""
    keys, start = S.word_sets(rows["text"])
    keys = keys & np.uint64((1 << 44) - 1)
    sig = np.stack([rows[c].to_numpy().view(np.uint64) for c in ("s0", "s1")], 1)
    size = np.diff(start)

    def linked(at: int, them: np.ndarray) -> np.ndarray:
        hit = S.distance(sig[them], sig[at]) <= near
        them = them[hit]
        own = keys[start[at] : start[at + 1]]
        n = size[them]
        other = keys[np.repeat(start[them] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        found = np.searchsorted(own, other)
        both = (np.append(own, 0)[found] == other) & (found < len(own))
        common = np.bincount(np.repeat(np.arange(len(them)), n), weights=both, minlength=len(them))
        hit[hit] = common >= least * (len(own) + n - common) - 1e-9
        return hit

    root = np.arange(len(sig))
    for a, b in S.reachable(len(sig), linked):
        root[b] = root[a]
    return root


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = NEAR, least: float = MIN_JACCARD) -> DataFrame:
    """Pairs (key, mark, duplicate_of): each document to remove and the one that stays for it.

    Documents are near if their signatures, over the set of their words of four
    or more bytes, are at most `near` bits apart and the Jaccard similarity of
    their word sets is at least `least`; equal texts are near. What near pairs
    connect is one group, of which the document with the least (key, mark)
    stays; mark is a fingerprint of the text. A pair of signatures `near` bits
    apart is compared with a chance of RECALL at least, nearer ones with a
    greater one, however many documents there are; no branch, group or number
    of partners is cut off. The key must be an integer, else TypeError. Rows
    with a null key, and null texts or ones without a word, are left alone, and
    so are rows that repeat in key and text (dedup() keeps one of these).
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer")
    marks = [F.xxhash64(text).alias("mark"), F.xxhash64(F.lit(1), text).alias("mark2")]
    d = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), *marks, F.octet_length(text).cast("long").alias("weight"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s0, s1, n = S.text_signatures(batch.column(4))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64))], ["key", "mark", "mark2", "weight", "s0", "s1"])
            yield out.filter(pa.array(n > 0))

    signed = cut_lineage(d.mapInArrow(sign, "key long, mark long, mark2 long, weight long, s0 long, s1 long"))
    # Equal texts are found by fingerprints of 128 bits; one of each goes on, under a number.
    distinct = signed.groupBy("mark", "mark2").agg(F.min("key").alias("key"), *[F.min(c).alias(c) for c in ("s0", "s1", "weight")])
    distinct = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("id"), "*"))
    edges = candidate_edges(distinct, near, RECALL, 11, forest_edges, PART)
    member = cut_lineage(connected_components(edges).select(F.col("vertex").alias("id"), "component").join(distinct, "id"))

    def fetch(wanted: DataFrame) -> DataFrame:
        return d.select("key", "mark", "mark2", "text").join(wanted.hint("shuffle_hash"), ["key", "mark", "mark2"]).select("component", "id", "weight", "s0", "s1", "text")

    groups = verified(member, fetch, lambda rows: near_texts(rows, near, least), PART_BYTES)
    roots = distinct.select("id", "mark", "mark2").join(groups.where("id <> root"), "id", "left").select("mark", "mark2", F.coalesce("root", "id").alias("group"))
    grouped = cut_lineage(signed.select("key", "mark", "mark2").distinct().join(roots, ["mark", "mark2"]).select("key", "mark", "group"))
    first = grouped.groupBy("group").agg(F.min(F.struct("key", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
    out = grouped.join(first, "group").where(F.struct("key", "mark") != F.col("first"))
    return out.select(F.col("key").alias(key), "mark", F.col("first.key").alias("duplicate_of"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = NEAR, least: float = MIN_JACCARD) -> DataFrame:
    """docs with one document of each group of duplicates(), in its columns.

    Of rows that repeat in key and text, one stays (any, if they differ in
    other columns). Rows with a null key, and null texts or ones without a
    word, stay as they are.
    """
    names = docs.columns
    mark = F.xxhash64(text)
    gone = cut_lineage(duplicates(docs.select(key, text), key, text, near, least).select(F.col(key).alias("gone_key"), F.col("mark").alias("gone_mark")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.col(key).alias("key"), mark.alias("mark"))
    rows = rows.join(gone.hint("shuffle_hash"), (F.col("key") == F.col("gone_key")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    twice = cut_lineage(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("gone_key"), mark.alias("gone_mark")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not twice.isEmpty():
        same = (F.col("key") == F.col("gone_key")) & (F.col("mark") == F.col("gone_mark"))
        rows = rows.join(twice, same, "left_anti").union(rows.join(twice, same, "left_semi").dropDuplicates(["key", "mark"]))
    return rows.select("d.*")
