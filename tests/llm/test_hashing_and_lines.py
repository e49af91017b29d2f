"""Sharding, quality rules and fuzzy lines against plain Python."""

import collections
import hashlib
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmill.llm import candidates, grams, linededup, neardup, quality, sharding, signatures
from scholarmill.operators.components import connected_components
from scholarmill.session import cut_lineage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], 1) for i, t in enumerate(texts)], DOCS)


def shards(sizes, limit):
    """{key: (depth, bits)} by splitting one bucket after another; sizes is {key: bytes}."""
    bits = {k: bin(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k in sizes}
    out, todo = {}, [("", list(sizes))]
    while todo:
        p, keys = todo.pop()
        if sum(sizes[k] for k in keys) <= limit or len({bits[k] for k in keys}) == 1 or len(p) == 60:
            out |= {k: (len(p), p) for k in keys}
        else:
            todo += [(p + b, [k for k in keys if bits[k][len(p)] == b]) for b in "01"]
    return out


@pytest.mark.parametrize("limit", [1, 50, 300, 10**9])
def test_shards_are_those_of_step_by_step_splits(spark, limit):
    rng = random.Random(limit)
    rows = [(k, "é" * rng.choice([0, 1, 3, 40])) for k in range(300)] + [(None, "x"), (None, None), (7, "twice"), (7, "twice")] + [(999, "x" * 5000)]
    sizes = collections.Counter()
    for k, t in rows:
        sizes[k] += len((t or "").encode())
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, depth int, bits int")
    want = shards(sizes, limit)
    got = sharding.shard(df, limit).collect()
    assert len(got) == len(rows)
    assert all((r.shard_depth, r.shard_id) == want[r.doc_id] for r in got)
    by = collections.Counter()
    for k in sizes:
        by[want[k]] += sizes[k]
    assert all(n <= limit or sum(want[k] == s for k in sizes) == 1 for s, n in by.items())


def test_shards_of_nothing_and_files(spark, tmp_path):
    assert sharding.shard(docs_of(spark, []), 10).collect() == []
    docs = docs_of(spark, ["a" * 30] * 20)
    sharding.write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard_id").exceptAll(docs).count() == 0 and back.count() == 20
    assert back.groupBy("shard_id").count().agg(F.max("count")).first()[0] <= 3


def test_line_quality_keeps_clean_and_cuts_boilerplate(spark):
    own = [f"own line {i} with words {i * 7}\nand another one {i * 13} here" for i in range(40)]
    texts = [t + "\nAll  Rights Reserved" if i < 20 else t for i, t in enumerate(own)] + ["all rights reserved"] * 3 + ["", None, "   \n \t", own[30], own[30]]
    texts += ["Copy of one\nand the same text"] * 12  # copies count once
    df = docs_of(spark, texts).withColumn("d", F.lit(1)).withColumn("kept", F.lit(None).cast("string")).withColumn("a.b", F.lit(2))
    got = {r.doc_id: r.text for r in quality.line_quality(df).collect()}
    assert quality.line_quality(df).columns == df.columns
    want = {i: own[i] for i in range(40)} | {46: own[30], 47: own[30]} | {48 + i: "Copy of one\nand the same text" for i in range(12)}
    assert got == want


def test_line_quality_ties_nulls_and_nothing(spark):
    assert quality.line_quality(docs_of(spark, [])).collect() == []
    # As many as the limit is not above it; one more is.
    at = docs_of(spark, [f"shared\nline {i} of its own and longer" for i in range(quality.MIN_DOCS)])
    assert quality.line_quality(at).where("text LIKE 'shared%'").count() == quality.MIN_DOCS
    above = docs_of(spark, [f"shared\nline {i} of its own and longer" for i in range(quality.MIN_DOCS + 1)], [None] * (quality.MIN_DOCS + 1))
    got = quality.line_quality(above).collect()
    assert len(got) == quality.MIN_DOCS + 1 and not any("shared" in r.text for r in got)


def test_line_quality_without_broadcast(spark, monkeypatch):
    texts = [f"boiler\nplate\nline {i} of its own and longer\n{'x ' * 2000}{i}" for i in range(30)] + [None, ""]
    df = docs_of(spark, texts)
    want = sorted(map(str, quality.line_quality(df).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)
    assert sorted(map(str, quality.line_quality(df).collect())) == want and len(want) == 30


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_quality_leaves_one_of_near_copies(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)
    lines = [f"line {i} of a text that is copied with {'many ' * (i % 4)}changes" for i in range(12)]
    near = ["\n".join(x if i != n % 12 else x + f" {n}" for i, x in enumerate(lines)) for n in range(60)]
    own = [f"own line {i} with words {i * 7}\nand another one {i * 13} here" for i in range(30)]
    got = {r.doc_id: r.text for r in quality.line_quality(docs_of(spark, [*near, near[0], *own], [None] * 91)).collect()}
    assert {i for i in got if i > 60} == set(range(61, 91))
    assert 1 <= len({t for i, t in got.items() if i <= 60}) <= 2 and all(t == near[min(i, 59) if i < 60 else 0] for i, t in got.items() if i <= 60)


def test_line_quality_cuts_boilerplate_of_hosts_of_any_size(spark):
    foot = "Released under the MIT license"
    for host in (200, 9000):
        texts = [f"own line {i} of a document with enough words of its own, such as {i * 7}" + ("\n" + foot + "\nok" if i < 60 else "") for i in range(host)]
        got = quality.line_quality(docs_of(spark, texts))
        assert got.count() == host and got.where(F.col("text").contains(foot)).count() == 0
        # A short line is judged by its share only.
        assert got.where(F.col("text").endswith("ok")).count() == (60 if host > 6000 else 0)


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_edit_similarity_is_exact():
    rng = random.Random(3)
    for _ in range(100):
        base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 14))]
        texts = [""]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))]
            texts.append(" ".join(w))
        s = linededup.Similarity(texts, 0.9)
        for i in range(len(texts)):
            want = [plain_distance(texts[i], t) <= 0.1 * max(len(texts[i]), len(t)) + 1e-9 for t in texts]
            assert s.near(i, np.arange(len(texts))).tolist() == want
            assert [linededup.within(texts[i], t, 0.1 * max(len(texts[i]), len(t))) for t in texts] == want
            assert all(linededup.within(texts[i], t, k) == (plain_distance(texts[i], t) <= k) for t in texts for k in (0, 1, 3, 9))


def words(rng, n):
    return [("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))) for _ in range(n)]


def test_fuzzy_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = []
    for _ in range(60):
        w = words(rng, rng.randint(12, 30))
        for _ in range(rng.choice([1, 1, 2, 4])):
            v = list(w)
            if rng.random() < 0.7:
                i = rng.randrange(len(v))
                v[i] = v[i][:-1] + rng.choice("xyz")
            lines.append(" ".join(v))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    got = {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(docs_of(spark, texts)).collect()}
    place = [(i // 3, i % 3) for i in range(len(lines))]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if plain_distance(lines[i], lines[j]) <= 0.1 * max(len(lines[i]), len(lines[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {place[i] for i in range(len(lines)) if root(i) != i}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("least_words,most_words", [(3, 5), (6, 12), (13, 20)])
def test_short_lines_with_edits_in_several_words(spark, least_words, most_words):
    rng = random.Random(least_words)
    lines = []
    for _ in range(150):
        w = words(rng, rng.randint(least_words, most_words))
        v = list(w)
        for i in rng.sample(range(len(v)), min(len(v), 4, max(1, len(" ".join(w)) // 20))):
            at = rng.randrange(len(v[i]))
            v[i] = v[i][:at] + rng.choice("xyz") + v[i][at + 1 :]
        lines += [" ".join(w), " ".join(v)]
    pairs = [i for i in range(0, len(lines), 2) if plain_distance(lines[i], lines[i + 1]) <= 0.1 * max(map(len, lines[i : i + 2]))]
    got = {(r.doc_id, r.kept_doc_id) for r in linededup.duplicate_lines(docs_of(spark, lines)).collect()}
    assert got <= {(i + 1, i) for i in pairs}
    assert len(pairs) > 100 and len(got) >= 0.9 * len(pairs)


def test_lines_between_short_and_long_are_one_group(spark):
    # Each is near the next one; the first has letters only, the last words only.
    base = [x + "abcdefghijklmnopqr"[i] * 2 for i, x in enumerate(["abcdefg", "jklmnop"] * 9)]
    lines = [" ".join(base[:n]) for n in range(12, 18)]
    assert len(lines[0]) < signatures.BOTH and len(lines[-1]) > signatures.SHORT
    assert all(plain_distance(a, b) <= 0.1 * len(b) for a, b in zip(lines, lines[1:]))
    got = {(r.doc_id, r.kept_doc_id) for r in linededup.duplicate_lines(docs_of(spark, lines)).collect()}
    assert got == {(i, 0) for i in range(1, len(lines))}


def test_lines_edges(spark):
    line = "one two three four five six seven eight nine ten"
    texts = [line, line.upper() + "!", None, "", "...\n***", line + "\nsomething else that stays here", "solo"]
    df = docs_of(spark, texts).unionByName(docs_of(spark, [line]))  # a repeated row
    df = df.withColumn("mark", F.lit(1)).withColumn("key", F.lit(2)).withColumn("hash", F.lit("x"))
    got = sorted((r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in linededup.duplicate_lines(df).collect())
    assert got == [(1, 0, 0, 0), (5, 0, 0, 0)]
    left = linededup.dedup_lines(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(0, line), (0, line), (4, "...\n***"), (5, "something else that stays here"), (6, "solo")]
    assert {r.doc_id for r in left.collect()} == {0, 2, 3, 4, 5, 6}
    empty = docs_of(spark, [])
    assert linededup.duplicate_lines(empty).collect() == [] and linededup.dedup_lines(empty).collect() == []
    nokey = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert linededup.dedup_lines(nokey).count() == df.count()


def test_lines_of_groups_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    lines = []
    for _ in range(8):
        w = words(rng, 40)
        for _ in range(12):
            v = list(w)
            v[rng.randrange(40)] = words(rng, 1)[0]
            lines.append(" ".join(v))
    df = docs_of(spark, lines)
    want = sorted(map(tuple, linededup.duplicate_lines(df).collect()))
    monkeypatch.setattr(linededup, "PART_BYTES", 1500)
    assert sorted(map(tuple, linededup.duplicate_lines(df).collect())) == want and len(want) >= 80


def test_plans_find_pairs_as_often_at_any_size():
    for near in (linededup.NEAR, neardup.NEAR):
        for n in (10, 10**6, 10**9, 10**12, 10**13):
            plan = signatures.plan(n, near, 0.9)
            assert n / 2**plan.width <= signatures.GROUP and all(plan.recall(d, near) >= 0.9 for d in range(near + 1))


@pytest.mark.parametrize("search", [signatures.group_edges, neardup.forest_edges])
def test_group_searches_reach_their_target(search, monkeypatch):
    monkeypatch.setattr(signatures, "MATRIX", 100)
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2**63, (6000, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (6000, 2), dtype=np.uint64)
    sig[3000:] = sig[:3000]
    apart = rng.integers(0, 25, 3000)
    for i, n in enumerate(apart):
        for b in rng.choice(128, n, replace=False):
            sig[3000 + i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    a, b = search(np.arange(6000), sig, 24, 0.6, 5)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    found = np.array([(i, i + 3000) in got for i in range(3000)])
    assert found[apart >= 20].mean() > 0.5 and found[apart < 12].mean() > 0.8 and found[apart == 0].all()
    assert all(signatures.distance(sig[x], sig[y]) <= 24 for x, y in got)


def test_hot_groupings_are_cut_by_further_bits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2**62, 2, dtype=np.uint64)
    sig = np.repeat(center[None], 900, 0)
    sig[600:] = rng.integers(0, 2**62, (300, 2), dtype=np.uint64)
    for i in range(600):
        for b in rng.choice(64, 4, replace=False):
            sig[i, 0] ^= np.uint64(1) << np.uint64(b)
    df = spark.createDataFrame([(i, int(x.astype(np.int64)), int(y.astype(np.int64))) for i, (x, y) in enumerate(sig)], "id long, s0 long, s1 long")
    want = {r.vertex for r in connected_components(candidates.candidate_edges(df, 20, 0.9, 1)).collect() if r.component < 600}
    plan = signatures.plan
    monkeypatch.setattr(signatures, "plan", lambda n, near, target: plan(n, near, target, 300))
    monkeypatch.setattr(signatures, "GROUP", 50)
    monkeypatch.setattr(candidates, "HOT", 200)
    got = connected_components(candidates.candidate_edges(df, 20, 0.9, 1)).collect()
    assert len(want) == 600 and len({r.vertex for r in got if r.vertex < 600}) >= 590 and len({r.component for r in got if r.vertex < 600}) <= 5


def test_large_groups_are_checked_in_parts(spark):
    """Numbers less than 10 apart are near; candidates are chains of them, also with gaps."""
    rng = random.Random(3)
    rows = []
    for c in range(4):
        at = 0
        for _ in range(120):
            at += rng.choice([1, 2, 8, 9] if c else [0, 1]) + (30 if rng.random() < 0.03 else 0)
            rows.append((c, 1000 * c + len(rows), 1, at))

    def check(t):
        x = t["value"].to_numpy()
        root = np.arange(len(x))
        for a, b in signatures.reachable(len(x), lambda i, them: abs(x[them] - x[i]) < 10):
            root[b] = root[a]
        return root

    df = spark.createDataFrame(rows, "component long, id long, weight long, value long")
    got = {r.id: r.root for r in candidates.verified(df, lambda m: m, check, 30).collect()}
    whole = {r.id: r.root for r in candidates.verified(df, lambda m: m, check, 10**6).collect()}
    assert got == whole and len(set(whole.values())) > 8
    assert candidates.verified(df.limit(0), lambda m: m, check, 30).collect() == []


def pairs_of_lines(rng, n, most_words, least_words=3):
    """Lines and copies of these with as many edits as similar ones may have, at random places."""
    out = []
    for _ in range(n):
        a = " ".join(words(rng, rng.randint(least_words, most_words)))
        b = list(a)
        for at in rng.sample(range(len(a)), int(0.1 * len(a))):
            b[at] = rng.choice("xyz")
        out += [a, "".join(b)]
    return out


def edges_of(spark, lines):
    df = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(lines)], "id long, n long, line string")
    return {(r.src, r.dst) for r in grams.similar_candidates(df, 0.9).collect()}


def test_edits_anywhere_lose_no_pair(spark):
    lines = pairs_of_lines(random.Random(21), 300, 60)
    want = {(i, i + 1) for i in range(0, len(lines), 2) if len(lines[i]) >= 10}
    got = {(r.kept_doc_id, r.doc_id) for r in linededup.duplicate_lines(docs_of(spark, lines)).collect()}
    assert got == want and len(want) == 300


def test_long_lines_of_large_tables_are_sampled(spark, monkeypatch):
    lines = pairs_of_lines(random.Random(22), 300, 80)
    monkeypatch.setattr(grams, "ALL", 0)
    got = edges_of(spark, lines)
    short = [i for i in range(0, len(lines), 2) if len(lines[i]) <= grams.EXACT]
    long = [i for i in range(0, len(lines), 2) if len(lines[i]) > grams.EXACT]
    assert short and all((i, i + 1) in got for i in short)
    assert len(long) > 100 and sum((i, i + 1) in got for i in long) >= 0.97 * len(long)


def test_keys_of_very_many_lines_lose_no_link(spark, monkeypatch):
    rng = random.Random(23)
    lines = pairs_of_lines(rng, 40, 40, 20)
    lines = [x + " and this end is the same in all of the lines" for x in lines]
    want = sorted(map(tuple, linededup.duplicate_lines(docs_of(spark, lines)).collect()))
    monkeypatch.setattr(grams, "HOT_PAIRS", 50)
    monkeypatch.setattr(grams, "HOT_LONG", 50)
    for all_ in (grams.ALL, 0):
        monkeypatch.setattr(grams, "ALL", all_)
        assert sorted(map(tuple, linededup.duplicate_lines(docs_of(spark, lines)).collect())) == want and len(want) >= 40


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = set(shuffle_bytes(spark))
    out = cut_lineage(spark.range(200_000).groupBy(F.xxhash64("id").alias("key")).agg(F.count("*").alias("n")))
    for _ in range(50):  # they are removed in the background
        if not set(shuffle_bytes(spark)) - before:
            break
        time.sleep(0.2)
    assert not set(shuffle_bytes(spark)) - before
    assert out.count() == 200_000


def test_pairs_of_one_key_take_little_memory():
    rng = np.random.default_rng(24)
    rec = np.zeros(2700, grams._LONG)
    rec["n"], rec["pos"], rec["id"] = 1000, rng.permutation(2700) * 101 % 900_000, np.arange(2700)
    monkey = grams.HOT_LONG
    grams.HOT_LONG = 10**9
    tracemalloc.start()
    try:
        edges = grams.shared_edges(rec, 0.9)
    finally:
        grams.HOT_LONG = monkey
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert len(edges) == 0 and peak < 150e6


def test_runs_have_equal_hashes_wherever_they_stand():
    codes = np.random.default_rng(25).integers(0, 3, 2000).astype("<u4")
    for size in (1, 2, 10, 14, 15, 16, 17):
        hashes, by = grams._run_hashes(codes, size), {}
        for i in range(len(codes) - size + 1):
            by.setdefault(codes[i : i + size].tobytes(), set()).add(int(hashes[i]))
        assert len(hashes) == len(codes) - size + 1 and all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_shares_of_a_forest_find_what_one_search_finds(spark):
    rng = np.random.default_rng(26)
    sig = rng.integers(0, 2**62, (3000, 2), dtype=np.uint64)
    sig[1500:2990] = sig[:1490] ^ (np.uint64(1) << rng.integers(0, 60, (1490, 2)).astype(np.uint64))
    sig[2990:] = sig[5]
    pairs = lambda *share: set(zip(*(x.tolist() for x in neardup.forest_edges(np.arange(3000), sig, 28, 0.9, 5, *share))))
    parts = [pairs((i, 4)) for i in range(4)]
    assert set.union(*parts) == pairs() and len(pairs()) >= 1490 and all(len(x) < len(pairs()) for x in parts)
    df = spark.createDataFrame([(i, int(x.astype(np.int64)), int(y.astype(np.int64))) for i, (x, y) in enumerate(sig)], "id long, s0 long, s1 long")
    edges = lambda part: {(r.src, r.dst) for r in candidates.candidate_edges(df, 28, 0.9, 5, neardup.forest_edges, part).collect()}
    assert edges(800) == edges(None)


def test_the_search_of_one_group_is_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(27)
    sig = rng.integers(0, 2**62, (2000, 2), dtype=np.uint64)
    df = spark.createDataFrame([(i, int(x.astype(np.int64)), int(y.astype(np.int64))) for i, (x, y) in enumerate(sig)], "id long, s0 long, s1 long")
    monkeypatch.setattr(neardup, "PART", 250)
    calls = spark.sparkContext.accumulator(0)

    def search(ids, sig, near, target, seed, *share):
        calls.add(1)
        return neardup.forest_edges(ids, sig, near, target, seed, *share)

    candidates.candidate_edges(df, 28, 0.9, 5, search, neardup.PART).collect()
    assert calls.value == 8


def test_a_key_of_very_many_unlike_lines_takes_little_time(spark, monkeypatch):
    rng = random.Random(25)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "en", "io", "ur")]

    def line(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    lines = [line(150) + " the passage that stands in all of these lines " + line(5) for _ in range(1500)]
    for i in range(0, 100, 2):
        at = rng.randrange(50, 500)
        lines[i + 1] = lines[i][:at] + "xyz" + lines[i][at + 3 :]
    monkeypatch.setattr(grams, "ALL", 0)
    monkeypatch.setattr(grams, "HOT_LONG", 1000)
    began = time.time()
    got = {(r.kept_doc_id, r.doc_id) for r in linededup.duplicate_lines(docs_of(spark, lines)).collect()}
    assert got == {(i, i + 1) for i in range(0, 100, 2)}
    # Comparing letter by letter what counts of pairs of letters allow for takes several times as long.
    alike = linededup.Similarity(lines[:200], 0.9)
    x, y = np.triu_indices(200, 1)
    may = (alike.bounds(x, y) <= 1).sum()
    assert may < 200 and time.time() - began < 120


def test_lines_of_one_key_meet_in_cells():
    rng = np.random.default_rng(26)
    rec = np.zeros(3000, grams._LONG)
    rec["n"] = rng.integers(90, 2000, 3000)
    rec["n"][:100], rec["n"][100:200] = np.arange(1, 101) * 10, np.arange(1, 101) * 9
    rec["pos"], rec["id"] = rng.random(3000) * (rec["n"] - 15).clip(0), np.arange(3000)
    cells, owns = [set() for _ in rec], [set() for _ in rec]
    for i, cell in grams._crowd(rec, 0.9).tolist():
        cells[i].add(cell // 2)
        if cell % 2:
            owns[i].add(cell // 2)
    n, pos = rec["n"].astype(int), rec["pos"].astype(int)
    x, y = np.triu_indices(3000, 1)
    moved = pos[x] - pos[y]
    fits = np.abs(moved) + np.abs(n[x] - n[y] - moved) <= grams.edits(np.maximum(n[x], n[y]), 0.9)
    assert fits.sum() > 1000 and all(owns[i] & cells[j] or owns[j] & cells[i] for i, j in zip(x[fits].tolist(), y[fits].tolist()))


def test_pairs_that_others_connect_are_not_compared(monkeypatch):
    base = " ".join(words(random.Random(27), 40))
    texts = [base[:i] + "#" + base[i + 1 :] for i in range(60)]
    x, y = np.triu_indices(60, 1)
    asked = []
    whole = linededup.words_apart
    monkeypatch.setattr(linededup, "words_apart", lambda *a: asked.append(1) or whole(*a))
    got = linededup.similar_pairs(x, y, np.arange(60), texts, 0.9)
    assert got.num_rows == 59 == len(asked)
