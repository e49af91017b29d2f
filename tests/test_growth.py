"""What a query shuffles and keeps in memory must not grow faster than its input."""

from pyspark.sql import functions as F

from scholarmill.functions import arrays
from scholarmill.operators import careers, citations as C, fields as FD, graph, networks as N
from scholarmill.plans import model as M
from scholarmill.session import spread


def shuffled(spark, make):
    """(rows of the result, records that its stages wrote to shuffles)."""
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    rows = make().collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def refs(spark, pairs):
    return spark.createDataFrame(pairs, "CitingPublicationId long, CitedPublicationId long")


def authors(spark, pairs):
    return spark.createDataFrame(pairs, "PublicationId long, AuthorId long")


def test_sparse_cosine_of_large_counts(spark):
    a = spark.createDataFrame([(0, "x", 4_000_000_000), (0, "y", 3_000_000_000)], "g int, k string, n long")
    assert abs(arrays.sparse_cosine(a, a, ["g"], "k", "n").first()["Cosine"] - 1) < 1e-12


def test_parts_grow_with_the_input(spark, tmp_path):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(3_000_000).select("id", F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/large")
    large = spark.read.parquet(f"{tmp_path}/large")
    assert spread(large, "id").rdd.getNumPartitions() > 2 * few
    assert spread(spark.createDataFrame([(1,)], "id long"), "id").rdd.getNumPartitions() == few


def test_tasks_that_read_keep_no_map_of_references(spark):
    plans = [M.pub2ref(spark, "/root/testdata/sf0.001"), M.author2pub(spark, "/root/testdata/sf0.001"), M.pub2field(spark, "/root/testdata/sf0.001"), N.cocitation(M.pub2ref(spark, "/root/testdata/sf0.001"))]
    for df in plans:
        lines = df._jdf.queryExecution().sparkPlan().toString().splitlines(), df._jdf.queryExecution().executedPlan().toString().splitlines()
        # Below the lowest exchange, nothing is aggregated.
        reads = [i for i, x in enumerate(lines[1]) if "FileScan" in x]
        for at in reads:
            below = next(i for i in range(at, -1, -1) if "Exchange" in lines[1][i])
            assert not any("Aggregate" in x for x in lines[1][below:at])


def test_disruption_skips_references_of_the_uncited(spark):
    rows, n = shuffled(spark, lambda: C.disruption(refs(spark, [(i, 1) for i in range(10, 610)] + [(5, 10), (10, 2)])))
    assert {r.PublicationId for r in rows} == {1, 2, 10} and n < 20_000


def test_credit_is_shared_without_pairs_of_references(spark):
    e = refs(spark, [(1, b) for b in range(10, 410)] + [(2, 10), (2, 11)])
    rows, n = shuffled(spark, lambda: C.credit_share(e, authors(spark, [(b, 7) for b in range(10, 410)] + [(11, 8)]), normed=False))
    got = {(r.PublicationId, r.AuthorId): r.CreditShare for r in rows}
    assert n < 20_000 and len(got) == 401
    assert got[10, 7] == 399.5 + 1.5 and got[11, 8] == 0.5 + 0.5 and got[12, 7] == 399.5


def test_pivot_scores_look_back_without_a_join_of_careers(spark):
    paa = spark.createDataFrame([(1, i, 2000 + i // 50) for i in range(300)], "AuthorId long, PublicationId long, Year int")
    cited = spark.createDataFrame([(i, j) for i in range(300) for j in (i % 7, i % 3)], "CitingPublicationId long, CitedJournalId long")
    rows, n = shuffled(spark, lambda: C.pivot_score(paa, cited, previous=3))
    assert n < 3_000
    vector = [{} for _ in range(300)]
    for i in range(300):
        for j in (i % 7, i % 3):
            vector[i][j] = vector[i].get(j, 0) + 1

    def want(i, past):
        total = {}
        for k in past:
            for j, c in vector[k].items():
                total[j] = total.get(j, 0) + c
        if total:
            return sum(c * total.get(j, 0) for j, c in vector[i].items()) / (sum(c * c for c in vector[i].values()) * sum(c * c for c in total.values())) ** 0.5

    year = lambda i: 2000 + i // 50
    for options, past in (({"previous": 3}, lambda i: range(max(0, i - 3), i)), ({"year_window": 1}, lambda i: [k for k in range(i) if year(k) >= year(i) - 1]), ({"previous": 9, "year_window": 0}, lambda i: [k for k in range(max(0, i - 9), i) if year(k) == year(i)]), ({}, range)):
        for r in C.pivot_score(paa, cited, **options).collect():
            w = want(r.PublicationId, past(r.PublicationId))
            assert (r.PivotScore is None) == (w is None) and (w is None or abs(r.PivotScore - w) < 1e-9)


def test_field_pairs_are_not_shuffled(spark):
    e = refs(spark, [(i, 1000 + i % 20) for i in range(100)])
    fields = spark.createDataFrame([(1000 + k, f) for k in range(20) for f in range(30)] + [(i, i % 30) for i in range(100)], "PublicationId long, FieldId int")
    distance = spark.createDataFrame([(i, j, 1.0) for i in range(30) for j in range(i + 1, 30)], "iFieldId int, jFieldId int, FieldDistance double")
    rows, n = shuffled(spark, lambda: FD.raostirling(e, fields, distance=distance))
    assert n < 6_000 and len(rows) == 100 and all(abs(r.RaoStirling - 435 / 900) < 1e-9 for r in rows)


def test_author_citations_travel_as_lists(spark):
    e = refs(spark, [(i, 100) for i in range(20)])
    a = authors(spark, [(i, 1000 + 40 * i + k) for i in range(20) for k in range(40)] + [(100, k) for k in range(50)])
    rows, n = shuffled(spark, lambda: graph.author_citations(e, a))
    assert len(rows) == 40_000 and all(abs(r.weight - 1 / 2000) < 1e-12 for r in rows) and n < 10_000


def test_longterm_fits_equal_series_once_and_alike(spark):
    t = [2000, 2001, 2001, 2002, 2004, 2004, 2005]
    df = spark.createDataFrame([(p, y) for p in range(400) for y in t] + [(p, y) for p in (500, 501) for y in (2000, 2001, 2003)], "CitedPublicationId long, CitingYear int")
    rows = {r.CitedPublicationId: r for r in careers.longterm_impact(df).collect()}
    assert len(rows) == 402 and rows[500].lam is None and len({(r.lam, r.mu, r.sig) for k, r in rows.items() if k < 400}) == 1
    import numpy as np

    one = careers._fit_many([np.array([1.0, 1, 2, 4, 4, 5])])[0]
    several = careers._fit_many([np.array([1.0, 2, 3]), np.array([1.0, 1, 2, 4, 4, 5]), np.arange(1.0, 40)])
    assert (one == several[1]).all() and abs(rows[0].lam - one[0]) == 0


def test_topics_of_a_career_with_many_parts(spark):
    import time

    paa = spark.createDataFrame([(1, i, 2000) for i in range(60_000)], "AuthorId long, PublicationId long, Year int")
    e = refs(spark, [(i, 100_000 + i // 2) for i in range(60_000)])
    began = time.perf_counter()
    rows = careers.career_topics(paa, e).collect()
    assert [(r.PublicationId, r.TopicCommunity, r.Degree) for r in rows] == [(0, 0, 1), (1, 0, 1)] and time.perf_counter() - began < 15


def test_fuzzy_matches_are_found_without_all_pairs(spark):
    from scholarmill.operators import text as T

    names = [(i, 1, f"Paper number {i * 7919 % 100_003:06d}") for i in range(1_500)] + [(i, 1, "One title of many") for i in range(9_000, 9_300)]
    df = spark.createDataFrame(names, "PublicationId long, Year int, Title string")
    rows, n = shuffled(spark, lambda: T.align_publications(df))
    got = {r.PublicationId: (r.match, r.Cosine) for r in rows}
    assert n < 200_000 and got[9_000] == (9_001, 1.0) and all(got[i] == (9_000, 1.0) for i in range(9_001, 9_300))
