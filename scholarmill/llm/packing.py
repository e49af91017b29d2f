"""Bin packing of documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarmill.session import cut_lineage

#: Room of a bin, in units of length: UTF-8 bytes unless docs has a column of lengths.
CAPACITY = 8192
#: Rows packed together, islands of such a group, individuals of an island.
GROUP_ROWS, ISLANDS, POPULATION = 2048, 3, 6
#: Rounds of evolution with a migration after each, and generations of a round.
ROUNDS, GENERATIONS = 3, 8


def best_fit(sizes: np.ndarray, items: list[int], bins: list[list[int]], rooms: list[int], capacity: int) -> None:
    """Put items, longest first, into the fullest bin with room for it, or a new one."""
    import bisect

    order = sorted(items, key=lambda i: (-sizes[i], i))
    by_room = sorted((r, b) for b, r in enumerate(rooms))
    for i in order:
        size = int(sizes[i])
        at = bisect.bisect_left(by_room, (size, -1))
        if at < len(by_room):
            room, b = by_room.pop(at)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
            rooms.append(capacity)
        rooms[b] = room - size
        bisect.insort(by_room, (rooms[b], b))


def fitness(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> float:
    """Falkenauer's: the mean square of how full the bins are."""
    return sum((sum(int(sizes[i]) for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by the total, and by items of over half a bin, which share none."""
    return max(math.ceil(int(sizes.sum()) / capacity), int((2 * sizes > capacity).sum()), int(len(sizes) > 0))


def settle(sizes: np.ndarray, loose: list[int], bins: list[list[int]], capacity: int) -> None:
    """Put loose items into bins, to which new ones are added: where one fills a bin better than one or two of its items, it takes their place, and they are loose instead; the rest is best-fitted."""
    import bisect

    rooms = [capacity - sum(int(sizes[i]) for i in x) for x in bins]
    rest = sorted((int(sizes[i]), i) for i in loose)
    for b, x in enumerate(bins):
        room = rooms[b]
        if not rest or not room:
            continue
        own = [(int(sizes[i]), i) for i in x]
        options = [(n, (i,)) for n, i in own] + [(n + m, (i, j)) for k, (n, i) in enumerate(own) for m, j in own[:k]]
        gain, at, out = 0, -1, ()
        for old, items in options:
            k = bisect.bisect_left(rest, (old + room + 1, -1)) - 1  # the longest that fits
            if k >= 0 and rest[k][0] - old > gain:
                gain, at, out = rest[k][0] - old, k, items
                if gain == room:
                    break
        if gain:
            bins[b] = [i for i in x if i not in out] + [rest.pop(at)[1]]
            rooms[b] -= gain
            for i in out:
                bisect.insort(rest, (int(sizes[i]), i))
    best_fit(sizes, [i for _, i in rest], bins, rooms, capacity)


def crossover(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of a with some of b's better filled bins whole.

    Bins of a that share items with these are taken apart; of their items,
    those that the injected bins have are duplicates, the others are settled.
    """
    if not b:
        return [list(x) for x in a]
    full = np.array([sum(int(sizes[i]) for i in x) for x in b])
    better = np.argsort(-full, kind="stable")[: max(1, (len(b) + 1) // 2)]
    n = int(rng.integers(1, max(2, len(better) // 2 + 1)))
    injected = [list(b[k]) for k in rng.choice(better, size=min(n, len(better)), replace=False)]
    inside = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in inside]
    bins = injected + kept
    settle(sizes, loose, bins, capacity)
    return bins


def mutated(bins: list[list[int]], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bins and a few others are taken apart and their items settled again."""
    full = np.array([sum(int(sizes[i]) for i in x) for x in bins])
    n = max(1, len(bins) // 10)
    gone = set(np.argsort(full, kind="stable")[:n].tolist()) | set(rng.integers(0, len(bins), n).tolist())
    kept = [list(x) for k, x in enumerate(bins) if k not in gone]
    settle(sizes, [i for k in sorted(gone) for i in bins[k]], kept, capacity)
    return kept


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None) -> list[list[int]]:
    """Best-fit decreasing, or with rng best fit in a random order."""
    bins: list[list[int]] = []
    rooms: list[int] = []
    if rng is None:
        best_fit(sizes, list(range(len(sizes))), bins, rooms, capacity)
    else:
        for part in np.array_split(rng.permutation(len(sizes)), max(1, len(sizes) // 64)):
            best_fit(sizes, part.tolist(), bins, rooms, capacity)
    return bins


def _dump(population: list[list[list[int]]], n: int) -> bytes:
    out = np.zeros((len(population), n), "<i4")
    for row, bins in zip(out, population):
        for k, x in enumerate(bins):
            row[x] = k
    return out.tobytes()


def _load(data: bytes, n: int) -> list[list[list[int]]]:
    out = []
    for row in np.frombuffer(data, "<i4").reshape(-1, n) if n else []:
        order = np.argsort(row, kind="stable")
        cuts = np.flatnonzero(np.diff(row[order])) + 1
        out.append([x.tolist() for x in np.split(order, cuts)])
    return out


def evolve(population: list[list[list[int]]], sizes: np.ndarray, capacity: int, generations: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """The population after some generations, best first; ends early at a packing that has been proven to be the best."""
    bound = lower_bound(sizes, capacity)
    scored = sorted(((len(x), -fitness(x, sizes, capacity)), k, x) for k, x in enumerate(population))
    count = len(scored)
    for _ in range(generations):
        if scored[0][0][0] <= bound:
            break
        known = {x[0] for x in scored}
        half = max(2, len(scored) // 2)
        for k in range(half):
            i, j = rng.integers(0, len(scored), 2)
            child = crossover(scored[min(i, j)][2], scored[max(i, j)][2], sizes, capacity, rng) if k % 2 else crossover(scored[i][2], scored[j][2], sizes, capacity, rng)
            if i == j or rng.random() < 0.66:
                child = mutated(child, sizes, capacity, rng)
            count += 1
            worth = (len(child), -fitness(child, sizes, capacity))
            # Children that are worth the same as another one are taken to be the same.
            if worth not in known:
                known.add(worth)
                scored.append((worth, count, child))
        scored = sorted(scored, key=lambda x: x[:2])[: len(population)]
    return [x for _, _, x in scored]


def _pieces(docs: DataFrame, key: str, length: str | None, text: str, capacity: int) -> DataFrame:
    """(key, length, group) of each row; the group by a hash of key and length."""
    size = F.col(length).cast("long") if length else F.octet_length(text).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("long").alias("length"))
    groups = max(1, math.ceil(docs.count() / GROUP_ROWS))
    # Rows that repeat are spread, or they would all be in one group.
    return rows.withColumn("group", F.pmod(F.xxhash64("key", "length", F.monotonically_increasing_id()), F.lit(groups)))


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """(key, piece, start, length, bin_id) for each piece of each row of docs; no bin holds more than capacity.

    The length of a row is its column `length`, or else the UTF-8 bytes of
    its text; nulls and negative lengths count as 0. A row longer than a bin
    is split without loss: pieces that fill a bin have one of their own, and
    the last piece, of the rest, is packed with others. A row of length 0 is
    one piece of length 0. Rows are packed in groups of about GROUP_ROWS, each
    by ISLANDS populations that evolve apart and, after each of ROUNDS rounds,
    send their best packing to the next island; a group is done when a packing
    has as few bins as the lower bound, which proves it to be the best.
    Repeated rows are packed each by itself, a null key stays null. bin_id has
    the group in its high bits. An empty table gives an empty result.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    # Written once, so that a lost executor can't number rows anew and lose or repeat one.
    rows = cut_lineage(_pieces(docs, key, length, text, capacity))
    start = rows.groupBy("group").applyInArrow(lambda rows: _islands(rows, capacity), f"group long, island int, keys array<{kind}>, lengths binary, population binary, bins int, done boolean")
    state = cut_lineage(start)
    for number in range(ROUNDS):
        if state.where("NOT done").isEmpty():
            break
        state = cut_lineage(_migrated(_evolved(state, capacity, number)))
    best = state.groupBy("group").agg(F.min_by(F.struct("keys", "lengths", "population"), F.struct("bins", "island")).alias("best")).select("group", "best.*")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield _rows_of(batch.column(0)[r].as_py(), batch.column(1)[r].values, batch.column(2)[r].as_py(), batch.column(3)[r].as_py(), capacity)

    out = best.mapInArrow(pieces, f"key {kind}, piece int, start long, length long, bin_id long")
    return out.withColumnRenamed("key", key)


def _rest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(full pieces, length of the rest) of each row; the rest is 0 only for a row of length 0 or of full pieces."""
    return lengths // capacity, lengths % capacity


def _items(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of the pieces that are to be packed."""
    full, rest = _rest(lengths, capacity)
    row = np.flatnonzero((rest > 0) | (full == 0))
    return row, rest[row]


def _islands(rows: pa.Table, capacity: int) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("key", "ascending")]).combine_chunks()
    group = rows["group"][0].as_py()
    lengths = rows["length"].to_numpy()
    _, sizes = _items(lengths, capacity)
    first = first_packing(sizes, capacity, None)
    done = len(first) <= lower_bound(sizes, capacity)
    n = 1 if done else ISLANDS
    populations = []
    for island in range(n):
        rng = np.random.default_rng([group, island])
        populations.append(_dump([first] + [first_packing(sizes, capacity, rng) for _ in range(0 if done else POPULATION - 1)], len(sizes)))
    keys = rows["key"].combine_chunks()
    keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(keys), pa.int32()), pa.concat_arrays([keys] * n))
    return pa.table([pa.array([group] * n, pa.int64()), pa.array(range(n), pa.int32()), keys, pa.array([lengths.astype("<i8").tobytes()] * n, pa.binary()), pa.array(populations, pa.binary()), pa.array([len(first)] * n, pa.int32()), pa.array([done] * n)], ["group", "island", "keys", "lengths", "population", "bins", "done"])


def _evolved(state: DataFrame, capacity: int, number: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf.index[~pdf["done"]]:
                _, sizes = _items(np.frombuffer(pdf.at[at, "lengths"], "<i8"), capacity)
                rng = np.random.default_rng([int(pdf.at[at, "group"]), int(pdf.at[at, "island"]), number + 1])
                population = evolve(_load(pdf.at[at, "population"], len(sizes)), sizes, capacity, GENERATIONS, rng)
                pdf.at[at, "population"] = _dump(population, len(sizes))
                pdf.at[at, "bins"] = len(population[0])
                pdf.at[at, "done"] = len(population[0]) <= lower_bound(sizes, capacity)
            yield pdf

    # Few bytes but much work: islands are spread over all tasks, or small files would be read by one.
    tasks = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    evolved = state.select("group", "island", "lengths", "population", "bins", "done").repartition(tasks, "group", "island").mapInPandas(run, "group long, island int, lengths binary, population binary, bins int, done boolean")
    return evolved.join(state.select("group", "island", "keys"), ["group", "island"])


def _migrated(state: DataFrame) -> DataFrame:
    """The last individual of each island gives way to the best of the island before; a group is done if one of its islands is."""
    state = cut_lineage(state)
    best = F.expr("substring(population, 1, cast(length(population) / %d as int))" % POPULATION)
    elite = state.where("NOT done").select("group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), best.alias("elite"))
    finished = state.where("done").select("group").distinct().withColumn("over", F.lit(True))
    joined = state.join(elite, ["group", "island"], "left").join(finished, "group", "left")
    last = F.expr("cast(length(population) / %d as int) * %d" % (POPULATION, POPULATION - 1))
    taken = F.when(F.col("elite").isNull() | F.col("done"), F.col("population")).otherwise(F.concat(F.substring("population", F.lit(1), last), "elite"))
    return joined.select("group", "island", "keys", "lengths", taken.alias("population"), "bins", F.coalesce("over", "done").alias("done"))


def _rows_of(group: int, keys: pa.Array, lengths: bytes, population: bytes, capacity: int) -> pa.RecordBatch:
    lengths = np.frombuffer(lengths, "<i8")
    row, sizes = _items(lengths, capacity)
    full, _ = _rest(lengths, capacity)
    where = np.frombuffer(population, "<i4", len(sizes)).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(lengths)), full)
    number = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
    used = int(where.max()) + 1 if len(where) else 0
    rows = np.concatenate([own, row])
    piece = np.concatenate([number, full[row]])
    size = np.concatenate([np.full(len(own), capacity, np.int64), sizes])
    bins = np.concatenate([used + np.arange(len(own)), where]) + (group << 32)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size), pa.array(bins)], ["key", "piece", "start", "length", "bin_id"])
