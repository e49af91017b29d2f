"""Groups of signatures that may be near each other, and the exact check of what is in them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarmill.llm import signatures as S
from scholarmill.operators.components import connected_components
from scholarmill.session import cut_lineage

#: A grouping's part with more than so many signatures is hot: its members are grouped again by further bits, so often that a near pair meets with this chance.
HOT, HOT_TARGET = 4 * S.GROUP, 0.95
#: Partitions that groups are spread over at most.
MOST_TASKS = 4000
#: Texts that are checked in one call, on average.
BUCKET = 2048


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Larger batches, so that packed rows are long."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _records(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(records, rows of bits) of a batch of (id, s0, s1, ...), longs all."""
    rec = np.stack([c.to_numpy() for c in batch.columns], 1)
    return rec, S.bit_rows(rec[:, 1:3].view(np.uint64))


def _pieces(value: np.ndarray) -> list[np.ndarray]:
    """Positions of equal values."""
    order = np.argsort(value, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(order) else []


def candidate_edges(signatures: DataFrame, near: int, target: float, seed: int, search: Callable = S.group_edges, part: int | None = None) -> DataFrame:
    """Edges (src, dst) among (id, s0, s1), ids being distinct longs: each pair of signatures up to `near` bits apart is found with at least the target chance at any number of rows, or connected through others.

    Signatures with counts (k0, k1) are found only where these allow for
    similarity, which loses no similar pair. Equal signatures are linked
    first, and one of them goes on. As planned by signatures.plan(), each is
    sent, 24 or 40 bytes, to one group for each table; a
    group is searched by one task, or, with `part`, by one for each `part` of
    its signatures: each has the whole group, and search does the share
    (number, of how many) that it is given. More than HOT signatures with the
    same bits are counted beforehand and grouped by further ones.
    """
    parts = [c for c in ("s0", "s1", "k0", "k1") if c in signatures.columns]
    every = signatures.select("id", *parts)
    heads = cut_lineage(every.groupBy(*parts).agg(F.min("id").alias("head"), F.count("*").alias("n")))
    same = every.join(heads.where("n > 1"), parts).where("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    distinct = heads.select(F.col("head").alias("id"), *parts)
    n = distinct.count()
    plan = S.plan(n, near, target)
    orders = S.orders(plan.tables, plan.width, seed)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 200_000):
            _, rows = _records(batch)
            for table, order in enumerate(orders):
                value, count = np.unique(S.prefix(rows, order, plan.width), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(table) << plan.width) + value.astype(np.int64)), pa.array(count)], ["cell", "n"])

    hot: dict[int, np.ndarray] = {}
    usual = max(1, math.ceil(min(n, S.GROUP) / part)) if part else 1
    shares: dict[int, int] = {}
    least = min(HOT, S.GROUP) if part else HOT
    if n > least:
        # There are at most tables * n / least of them.
        for r in distinct.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect():
            if r["n"] <= HOT:
                shares[r["cell"]] = math.ceil(r["n"] / part)
                continue
            width = min(48, math.ceil(math.log2(r["n"] / S.GROUP)))
            rng = np.random.default_rng([seed, r["cell"]])
            rest = orders[r["cell"] >> plan.width][plan.width :]
            hot[r["cell"]] = np.array([rng.permutation(rest)[:width] for _ in range(S.draws(S.agree(width, near), HOT_TARGET))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 200_000):
            rec, rows = _records(batch)
            for table, order in enumerate(orders):
                value = S.prefix(rows, order, plan.width)
                cells, payload = [], []
                for piece in _pieces(value):
                    cell = (table << plan.width) + int(value[piece[0]])
                    if cell not in hot:
                        cells.append((cell, -1, 0, shares.get(cell, usual)))
                        payload.append(rec[piece].tobytes())
                        continue
                    for number, further in enumerate(hot[cell]):
                        own = S.prefix(rows[:, piece], further, len(further))
                        for part_ in _pieces(own):
                            cells.append((cell, number, int(own[part_[0]]), usual))
                            payload.append(rec[piece[part_]].tobytes())
                columns = list(zip(*cells)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(payload, pa.binary())], ["cell", "again", "value", "shares", "payload"])

    def found(group: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(group["payload"].to_pylist()), np.int64).reshape(-1, 1 + len(parts))
        share = [(group["share"][0].as_py(), group["shares"][0].as_py())] if part else []
        a, b = search(rec[:, 0].copy(), rec[:, 1:].copy().view(np.uint64), near, plan.local, [seed, group["cell"][0].as_py()], *share)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    packed = distinct.mapInArrow(send, "cell long, again long, value long, shares long, payload binary")
    packed = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    names = ["cell", "again", "value", "share"]
    if part:
        # As many tasks as searches, not as many as their bytes ask for.
        packed = packed.repartition(min(MOST_TASKS, 4 * usual * (plan.tables << plan.width)), *names)
    return packed.groupBy(*names).applyInArrow(found, "src long, dst long").distinct().union(same)


def verified(member: DataFrame, fetch: Callable[[DataFrame], DataFrame], check: Callable[[pa.Table], np.ndarray], limit: int) -> DataFrame:
    """(id, root) of each member of candidate groups (component, id, weight, ...): groups of what is really near, named by their least id.

    fetch adds the texts; check gives, for the rows of a group by id, each
    one's root among them. Groups up to `limit` are checked whole, many in a
    call. The members of a larger one are checked in parts, each with the
    group's first member; those that it doesn't reach then meet all parts and
    each other, also in parts. So all members are held against each other but
    those that are already known to be connected, and copies of one text,
    however many, pass once.
    """
    spark = member.sparkSession
    # What a call has depends on the work, not on the bytes that adaptive execution joins partitions by.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(member.count() / BUCKET))
    sizes = cut_lineage(member.groupBy("component").agg(F.sum("weight").alias("total"), F.min("id").alias("first")))
    large = sizes.where(F.col("total") > limit)
    keep = ["component", "id", "part"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("component", "part", "id")])
        component, id_, part = (rows[c].to_numpy() for c in keep)
        first = np.ones(len(id_), bool)
        first[1:] = (component[1:] != component[:-1]) | (part[1:] != part[:-1]) | (id_[1:] != id_[:-1])
        at = np.flatnonzero(first)
        rows, component, id_, part = rows.take(pa.array(at)), component[at], id_[at], part[at]
        heads = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (part[1:] != part[:-1])]))
        root = id_.copy()
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(id_)]):
            if b - a > 1:
                root[a:b] = id_[a:b][check(rows.slice(a, b - a))]
        return pa.table({"component": component, "id": id_, "root": root})

    def checked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("component", "part"), F.lit(8 * tasks))).repartition(tasks, "bucket")
        return rows.groupBy("bucket").applyInArrow(run, "component long, id long, root long")

    if large.isEmpty():
        return checked(fetch(member).withColumn("part", F.lit(0).cast("long"))).select("id", "root")
    small = member.join(large.select("component"), "component", "left_anti")
    out = checked(fetch(small).withColumn("part", F.lit(0).cast("long"))).select("id", "root")
    texts = cut_lineage(fetch(member.join(large.select("component"), "component", "left_semi")))
    parts = F.ceil(2 * F.col("total") / limit)
    own = F.pmod(F.xxhash64("id"), parts)
    cut = texts.join(large, "component").withColumn("parts", parts).withColumn("own", own)
    everywhere = F.when(F.col("id") == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("own"))
    linked = cut_lineage(checked(cut.withColumn("part", F.explode(everywhere)).drop("total", "first", "parts", "own")))
    reached = linked.join(large.select("component", "first"), "component").where("root = first").select("id").distinct()
    rest = cut_lineage(cut.join(reached, "id", "left_anti").select("component", "id", "weight"))
    if not rest.isEmpty():
        some = rest.groupBy("component").agg(F.ceil(2 * F.sum("weight") / limit).alias("others"))
        cut = cut.join(some, "component").join(rest.select("id", F.lit(True).alias("late")), "id", "left")
        other = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("others"))
        parts_, others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
        # Cells (part of those reached, part of the rest), and (part of the rest, part of the rest) behind them.
        meets = F.when(F.col("late"), F.concat(F.transform(parts_, lambda p: p * F.col("others") + other), F.transform(others, lambda q: (F.col("parts") + F.least(q, other)) * F.col("others") + F.greatest(q, other))))
        meets = meets.otherwise(F.transform(others, lambda q: F.col("own") * F.col("others") + q))
        again = checked(cut.withColumn("part", F.explode(meets)).drop("total", "first", "parts", "own", "others", "late"))
        linked = cut_lineage(linked.union(again))
    whole = connected_components(linked, "id", "root").select(F.col("vertex").alias("id"), F.col("component").alias("root"))
    return out.union(whole)
