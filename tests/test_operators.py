"""Operators against worked toy graphs and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmill.functions import arrays, text as X
from scholarmill.operators import aggregates as A, careers, citations as C, embedding, fields as FD, filters, graph, impact, networks as N, ranking as R, text as T
from scholarmill.operators.components import connected_components
from scholarmill.schema import MetricError, require_columns

REFS = [(11, 0, 2014), (11, 1, 2014), (11, 2, 2014), (11, 3, 2014), (12, 0, 2015), (12, 2, 2015), (12, 3, 2015), (13, 0, 2015), (13, 2, 2015), (13, 4, 2015), (14, 0, 2018), (15, 0, 2020), (15, 2, 2020), (15, 3, 2020), (15, 4, 2020)]
AUTHORS_A = {0: [1, 2], 1: [1], 2: [1, 3, 4, 5], 3: [1], 4: [6, 7, 8]}
AUTHORS_B = {0: [1, 2], 1: [1, 2], 2: [1, 2, 3, 4], 3: [1, 2, 5], 4: [6, 7]}
FIELDS = {0: [1, 2], 1: [1], 2: [3], 3: [2, 3], 4: [3], 11: [1], 12: [3], 13: [3], 14: [1], 15: [1, 2]}


@pytest.fixture
def refs(spark):
    return spark.createDataFrame(REFS + REFS[:3] + [(None, 3, 2015)], "CitingPublicationId long, CitedPublicationId long, CitingYear int")


def pairs(spark, d, names):
    return spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], names)


def table(df, key, *values):
    cut = lambda x: round(x, 6) if isinstance(x, float) else x
    return {r[key] if isinstance(key, str) else tuple(r[k] for k in key): cut(r[values[0]]) if len(values) == 1 else tuple(cut(r[v]) for v in values) for r in df.collect()}


def test_credit_share(spark, refs):
    for authors, want in ((AUTHORS_A, {1: 0.75, 2: 0.25}), (AUTHORS_B, {1: 0.5, 2: 0.5})):
        a = pairs(spark, authors, "PublicationId long, AuthorId long")
        got = table(C.credit_share(refs, a).where("PublicationId = 0"), "AuthorId", "CreditShare")
        assert got == want
    a = pairs(spark, AUTHORS_A, "PublicationId long, AuthorId long")
    got = table(C.credit_share(refs, a, year="CitingYear").where("PublicationId = 0 AND AuthorId = 1"), "CitingYear", "CreditShare")
    assert got == {2014: 0.846154, 2015: 0.777778, 2018: 0.741935, 2020: 0.75}
    raw = table(C.credit_share(refs, a, normed=False, focus=spark.createDataFrame([(0,)], "PublicationId long")), "AuthorId", "CreditShare")
    assert raw == {1: 7.5, 2: 2.5}


def test_interdisciplinarity(spark, refs):
    f = pairs(spark, FIELDS, "PublicationId long, FieldId long")
    assert table(FD.simpson_interdisciplinarity(refs, f), "PublicationId", "SimpsonInterdisciplinarity") == {11: 0.666667, 12: 0.64, 13: 0.625, 14: 0.5, 15: 0.611111}
    assert table(FD.simpson_interdisciplinarity(refs, f, finite=True), "PublicationId", "SimpsonInterdisciplinarity") == {11: 0.8, 12: 0.8, 13: 0.833333, 14: 1.0, 15: 0.733333}
    assert table(FD.shannon_interdisciplinarity(refs, f, normalised=True), "PublicationId", "ShannonInterdisciplinarity") == {11: 1.0, 12: 0.96023, 13: 0.946395, 14: 0.63093, 15: 0.92062}
    v = table(FD.field_citation_vectors(refs, f), ("SourceFieldId", "TargetFieldId"), "Weight")
    assert v == {(1, 1): 2.25, (1, 2): 2.0, (1, 3): 2.75, (2, 1): 0.25, (2, 2): 0.5, (2, 3): 1.25, (3, 1): 1.0, (3, 2): 1.5, (3, 3): 3.5}
    assert table(FD.field_citation_distance(refs, f), ("iFieldId", "jFieldId"), "FieldDistance") == {(1, 2): 0.104453, (1, 3): 0.073362, (2, 3): 0.002961}
    assert table(FD.raostirling(refs, f), "PublicationId", "RaoStirling") == {11: 0.020387, 12: 0.01241, 13: 0.011382, 14: 0.026113, 15: 0.009458}
    more = f.union(spark.createDataFrame([(99, 9)], f.schema))
    assert table(FD.field_citation_distance(refs, more).where("jFieldId = 9"), "iFieldId", "FieldDistance") == {1: 1.0, 2: 1.0, 3: 1.0}
    assert set(table(FD.field_citation_distance(refs, f, metric="euclidean"), ("iFieldId", "jFieldId"), "FieldDistance")) == {(1, 2), (1, 3), (2, 3)}
    with pytest.raises(MetricError):
        FD.field_citation_distance(refs, f, metric="other")


def test_disruption(spark, refs):
    more = refs.union(spark.createDataFrame([(0, 20, 2014), (0, 21, 2014), (11, 20, 2014), (16, 21, 2016)], refs.schema))
    assert table(C.disruption(more, mode="reference"), "PublicationId", "Disruption")[0] == 0.428571
    got = table(C.disruption(more), "PublicationId", "Disruption")
    assert got[0] == 0.5 and got[1] is None


def brute_disruption(edges, mode):
    edges = set(edges)
    out = {}
    for focus in {b for _, b in edges}:
        f = {a for a, b in edges if b == focus}
        r = {b for a, b in edges if a == focus}
        s = {a for a, b in edges if b in r} - ({focus} if mode == "paper" else set())
        j = len(f & s)
        out[focus] = round((len(f) - 2 * j) / (len(f) - j + len(s)), 6) if r else None
    return out


def test_disruption_on_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)]
    df = spark.createDataFrame(edges + edges[:20], "CitingPublicationId long, CitedPublicationId long")
    for mode in ("paper", "reference"):
        got = table(C.disruption(df, mode=mode), "PublicationId", "Disruption")
        assert got == brute_disruption(edges, mode) and all(v is None or -1 <= v <= 1 for v in got.values())


def test_impact_and_self_citations(spark, refs):
    year = spark.createDataFrame([(0, 2013), (1, 2016), (2, 2010), (3, None), (11, 2014), (12, 2015), (13, 2015), (14, 2018), (15, 2020)], "PublicationId long, Year int")
    authors = pairs(spark, {0: [1], 12: [1], 2: [2], 15: [None]}, "PublicationId long, AuthorId long")
    got = table(impact.compute_impact(refs, year, authors, (2,)), "PublicationId", "Year", "Ctotal", "C2", "Ctotal_noself", "C2_noself")
    assert got == {0: (2013, 5, 3, 4, 2), 2: (2010, 4, 0, 4, 0), 3: (0, 3, 0, 3, 0), 4: (0, 2, 0, 2, 0)}
    assert impact.remove_selfcitations(refs, authors).where("CitingPublicationId = 12 AND CitedPublicationId = 0").count() == 0
    assert set(table(impact.yearly_citations(refs, year), ("PublicationId", "CitingYear"), "YearlyCitations").items()) >= {((0, 2015), 2)}
    assert impact.compute_impact(refs.limit(0), year).collect() == []


COUNTS = {"a": [25, 8, 5, 3, 3], "b": [1, 1, 1], "c": [10, 0, 0, 0, 0, 0], "d": [0], "e": [3, 3, 3, None]}


def test_indices(spark):
    df = pairs(spark, COUNTS, "g string, n long").union(spark.createDataFrame([(None, 5)], "g string, n long"))
    assert table(A.hindex(df, "g", "n"), "g", "gHindex") == {"a": 3, "b": 1, "c": 1, "d": 0, "e": 3}
    assert table(A.gindex(df, "g", "n"), "g", "gGindex")["c"] == 3
    ref = table(A.gindex(df, "g", "n", "reference"), "g", "gGindex")
    assert ref["b"] == 2 and ref["c"] == 4
    assert table(A.gindex(df, "g", "n"), "g", "gGindex")["b"] == 1
    assert table(A.qfactor(df, "g", "n"), "g", "gQfactor")["d"] is None
    assert table(A.cindex(df, "g", "n"), "g", "gCindex")["a"] == 25 and table(A.pindex(df, "g", "n"), "g", "gPindex")["c"] == 1
    assert table(A.groupby_count(df, "g", "n"), "g", "nCount") == {"a": 4, "b": 1, "c": 2, "d": 1, "e": 1}
    with pytest.raises(KeyError):
        require_columns(df, "nope")


def test_ranking(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(0, 6), rng.random() < 0.5) for g in "xy" for i in range(25)] + [("z", 1, 3, True)]
    df = spark.createDataFrame(rows, "g string, i long, v long, x boolean")
    for g, a in table(R.auc(df, "g", "v", "x"), "g", "AUC").items():
        p, q = [r[2] for r in rows if r[0] == g and r[3]], [r[2] for r in rows if r[0] == g and not r[3]]
        want = round(sum((a > b) + 0.5 * (a == b) for a in p for b in q) / len(p) / len(q), 6) if p and q else None
        assert a == want
    for g, (a, var) in table(R.delong(df, "g", "v", "x"), "g", "AUC", "Variance").items():
        p, q = [r[2] for r in rows if r[0] == g and r[3]], [r[2] for r in rows if r[0] == g and not r[3]]
        if len(p) > 1 and len(q) > 1:
            h = [[(a > b) + 0.5 * (a == b) for b in q] for a in p]
            assert var == round(np.var(np.mean(h, 1), ddof=1) / len(p) + np.var(np.mean(h, 0), ddof=1) / len(q), 6)
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005), (5, None)], "id long, p double").withColumn("g", F.lit(1))
    assert table(R.holm(p, "p", ["g"], "id"), "id", "Reject") == {1: True, 2: False, 3: False, 4: True, 5: None}
    one = R.rank(df, "v", "g", "i", normed=True).where("g = 'z'").first()
    assert one.vRank is None
    w = R.rolling(df.where("g = 'x'"), "g", "i", "v", 5, "plain")
    assert w.count() == 20 and all(len(r.Window) == 5 for r in w.collect())
    assert [r.Position for r in R.change_points(spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, 2, 1])], "g string, i int, v int"), "g", "i", "v").orderBy("Position").collect()] == [0, 2, 4, 5]


def test_networks(spark, refs):
    co = table(N.cocitation(refs), ("src", "dst"), "weight")
    assert co == {(0, 1): 1, (0, 2): 4, (0, 3): 3, (1, 2): 1, (1, 3): 1, (2, 3): 3, (0, 4): 2, (2, 4): 2, (3, 4): 1}
    assert table(N.coupling(refs), ("src", "dst"), "weight")[11, 15] == 3
    ego = N.cocitation(refs, spark.createDataFrame([(1,)], "id long"), "egocited")
    assert table(ego, ("src", "dst"), "weight") == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (1, 2): 1, (1, 3): 1, (2, 3): 1}
    paa = pairs(spark, AUTHORS_A, "PublicationId long, AuthorId long")
    assert table(N.coauthorship(paa), ("src", "dst"), "weight")[1, 2] == 1
    focus = spark.createDataFrame([(2,)], "AuthorId long")
    assert [N.coauthorship(paa, focus, c).count() for c in ("authors", "publications", "ego")] == [0, 1, 1]
    star = spark.createDataFrame([(0, i, 100 if i == 1 else 1) for i in range(1, 8)] + [(9, 0, 5)], "src long, dst long, weight long")
    assert [(r.src, r.dst) for r in N.backbone(star, 0.05).collect()] == [(0, 1)]
    moves = spark.createDataFrame([(1, y, p, a) for p, (y, a) in enumerate([(2000, 5), (2001, 5), (2002, 6), (2003, 5), (2004, None)])], "AuthorId long, Year int, PublicationId long, AffiliationId long")
    assert [(r.AffiliationId, r.next_AffiliationId) for r in N.trajectory(moves).orderBy("Year").collect()] == [(5, 6), (6, 5)]


def test_components_and_ranks(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges[:-1]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = table(connected_components(spark.createDataFrame(edges, "src long, dst long")), "vertex", "component")
    assert got == {i: root(i) for i in parent}
    g = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    pr = table(graph.pagerank(g), "vertex", "PageRank")
    assert abs(sum(pr.values()) - 1) < 1e-5
    x = np.full(4, 0.25)
    m = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0.5, 0, 0, 0.5], [0.25] * 4])
    for _ in range(200):
        x = 0.85 * x @ m + 0.15 / 4
    assert all(abs(pr[i + 1] - x[i]) < 1e-4 for i in range(4))
    ring = spark.createDataFrame([(i, (i + 1) % 4, 1.0) for i in range(4)] + [((i + 1) % 4, i, 1.0) for i in range(4)], "src long, dst long, weight double")
    assert set(table(graph.eigenvector(ring), "vertex", "Centrality").values()) == {0.5}
    assert table(N.largest_component(spark.createDataFrame([(1, 2), (5, 6), (8, 9), (9, 10)], "src long, dst long")), "vertex", "vertex") == {8: 8, 9: 9, 10: 10}


def test_sleeping_beauty(spark):
    c = spark.createDataFrame([("a", 2000 + i, n) for i, n in enumerate([0, 0, 1, 0, 6, 2])] + [("b", 2000, 5), ("b", 2003, 1)], "g string, Year int, n long")
    assert table(C.sleeping_beauty(c, "g", "n"), "g", "BeautyCoefficient", "Awakening") == {"a": (8.0, 2003), "b": (None, 2000)}
    assert table(C.sleeping_beauty(c, "g", "n", mode="reference"), "g", "BeautyCoefficient")["a"] == 7.5
    gap = c.where("NOT (g = 'a' AND n = 0 AND Year > 2000)")
    assert table(C.sleeping_beauty(gap, "g", "n"), "g", "BeautyCoefficient")["a"] == 8.0


def test_pivot_and_netnorm(spark):
    paa = spark.createDataFrame([(1, 1, 2000), (1, 2, 2001), (1, 3, 2002), (2, 3, 2002)], "AuthorId long, PublicationId long, Year int")
    refs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 9)], "CitingPublicationId long, CitedJournalId long")
    assert table(C.pivot_score(paa, refs), ("AuthorId", "PublicationId"), "PivotScore") == {(1, 1): None, (1, 2): round(1 / math.sqrt(2), 6), (1, 3): 0.0, (2, 3): None}
    dated = spark.createDataFrame([(10, 1, 2001, 2000), (10, 2, 2001, 1999), (11, 2, 2001, 1999), (12, 1, 2009, 2000)], "CitingPublicationId long, CitedPublicationId long, CitingYear int, CitedYear int")
    assert table(C.netnormcite(dated, 5), "PublicationId", "Cnorm5") == {1: 0.5, 2: 2.0}


def test_careers(spark):
    rng = random.Random(5)
    rows = [(1, i, f"{1990 + i // 4}-01-{1 + i % 4:02d}", 1000.0 if 40 <= i < 60 else 3.0 + rng.random()) for i in range(100)] + [(2, i, f"19{50 + i}-01-01", 5.0) for i in range(30)] + [(2, 99, "1999-01-01", 0.0)]
    out = {r.AuthorId: r for r in careers.hot_streak(spark.createDataFrame(rows, "AuthorId long, PublicationId long, Date string, C10 double")).collect()}
    assert out[2].StreakStart is None and out[1].StreakGamma > out[1].Baseline
    assert "1999" <= out[1].StreakStart[:4] <= "2001" and "2003" <= out[1].StreakEnd[:4] <= "2006"
    x = [(1, y, float(y - 2000 if y <= 2006 else 6 - 2 * (y - 2006))) for y in range(2000, 2010)] + [(2, 2000, 1.0)]
    fit = {r.AuthorId: r for r in careers.productivity_trajectory(spark.createDataFrame(x, "AuthorId long, Year int, YearlyProductivity double")).collect()}
    assert abs(fit[1].t_break - 2006) < 0.05 and abs(fit[1].m1 - 1) < 0.05 and abs(fit[1].m2 + 2) < 0.1 and fit[2].b is None
    t = np.linspace(0.5, 60, 4000)
    y = careers.predicted_citations(t, 2.0, 1.5, 0.8)
    times = [0.0] + [float(t[np.searchsorted(y, k)]) for k in range(1, 60)]
    lam, mu, sig = careers._fit_longterm(np.array(times[1:]))
    assert abs(lam - 2) < 0.15 and abs(mu - 1.5) < 0.15 and abs(sig - 0.8) < 0.15
    edges = [(a, b, 1.0) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 5, 1.0)]
    assert careers.louvain(list(range(10)), edges) == [0] * 5 + [1] * 5
    paa = spark.createDataFrame([(1, p, 2000 + p) for p in range(4)] + [(1, 9, 2009)], "AuthorId long, PublicationId long, Year int")
    refs = spark.createDataFrame([(0, 50), (1, 50), (2, 51), (3, 51), (2, 50)], "CitingPublicationId long, CitedPublicationId long")
    topics = careers.career_topics(paa, refs).collect()
    assert sorted(r.PublicationId for r in topics) == [0, 1, 2, 3] and sum(r.Degree for r in topics) == 8


def test_text(spark):
    df = spark.createDataFrame([(1, "Müller, J. (Jr) - Ågren & Co", {"b": [1], "a": [0, 2]}, "HTTPS://doi.org/10.1/AB"), (2, None, None, None)], "id int, n string, m map<string, array<int>>, d string")
    r = df.select("id", X.clean_person_name(F.col("n")).alias("p"), X.clean_institution_name(F.col("n")).alias("i"), X.abstract_text(F.col("m")).alias("t"), X.standard_doi(F.col("d")).alias("d"), X.strip_accents("n").alias("s")).orderBy("id").collect()
    assert r[0].p == "Muller- J -Agren&Co" and r[0].i == "Muller J Agren and Co" and r[0].t == "a b a" and r[0].d == "10.1/ab" and r[1].t == "" and r[1].p is None
    names = spark.createDataFrame([("Ada B. Lovelace",), ("Lovelace, Ada",), ("Plato",), ("van Gogh, Vincent W",)], "n string").select(X.name_parts(F.col("n")).alias("x")).select("x.*").collect()
    assert [tuple(x) for x in names] == [("Lovelace", "Ada", "B."), ("Lovelace", "Ada", ""), ("Plato", "", ""), ("van Gogh", "Vincent", "W")]
    s = spark.createDataFrame([("abcd", "abed"), ("", ""), (None, "x")], "a string, b string").select(X.indel_ratio("a", "b").alias("r")).collect()
    assert [x.r for x in s] == [0.75, 1.0, None]
    left = spark.createDataFrame([(1, 2000, "a study of citation networks"), (2, 2000, "completely different words"), (3, 2001, "a study of citation networks"), (4, 2000, None)], "PublicationId long, Year int, Title string")
    right = spark.createDataFrame([(7, 2000, "a study of citation network"), (8, 2000, "a study of rank networks"), (9, 1999, "completely different words")], left.schema)
    assert table(T.align_publications(left, right), "PublicationId", "match") == {1: 7}
    words = spark.createDataFrame([(1, "The cat sat, cat!"), (1, "The cat sat, cat!"), (2, "A cat élan"), (3, None)], "PublicationId long, Title string")
    assert table(T.coword_network(words), ("src", "dst"), "weight") == {("cat", "cat"): 5, ("cat", "sat"): 2, ("sat", "sat"): 1, ("cat", "elan"): 1, ("elan", "elan"): 1}


def test_arrays(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.9, 0.1])], "p array<double>, q array<double>")
    r = df.select(arrays.kl(F.col("p"), F.col("q")).alias("k"), arrays.kl(F.col("p"), F.col("q"), "reference").alias("n"), arrays.jensen_shannon(F.col("p"), F.col("p")).alias("j"), arrays.human_size(F.lit(1536)).alias("h")).first()
    assert round(r.k, 6) == 0.736966 and r.n == -r.k and r.j == 0 and r.h == "1.5 KB"


def test_filters(spark, refs):
    pub = spark.createDataFrame([(1, 2000, "j"), (2, 2001, "b"), (3, None, "j"), (4, 2001, "j")], "PublicationId long, Year int, DocType string")
    field = spark.createDataFrame([(1, 5), (4, 6), (4, 5), (None, 5)], "PublicationId long, FieldId long")
    ids = filters.publication_ids([filters.YearFilter(2000, 2001), filters.DocTypeFilter(["j"]), filters.FieldFilter([6, 5])], pub, field)
    assert {r[0] for r in ids.collect()} == {1, 4}
    assert filters.publication_ids(filters.FieldFilter([]), pub, field).collect() == []
    with pytest.raises(TypeError):
        filters.publication_ids(filters.JournalFilter([1]), pub, field)
    with pytest.raises(ValueError):
        filters.YearFilter()
    assert filters.in_ids(pub, "PublicationId", spark.createDataFrame([(4,), (1,), (4,)], "x long")).count() == 2
    assert filters.in_ids(pub, "PublicationId", spark.createDataFrame([(4,)], "x long"), negate=True).count() == 3


def test_walks(spark):
    g = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    walks = embedding.random_walks(g, 5, 15, 0.5, 2.0).collect()
    allowed = {(1, 2), (2, 3), (3, 1), (3, 4)}
    assert len(walks) == 20 and all(set(zip(w.path, w.path[1:])) <= allowed for w in walks)
    assert all(len(w.path) == 15 or w.path[-1] == 4 for w in walks)
    vectors = embedding.node2vec(g, 5, 10, dimensions=8).collect()
    assert {v.vertex for v in vectors} == {"1", "2", "3", "4"} and len(vectors[0].embedding) == 8


def test_order_of_rows_makes_no_difference(spark, refs):
    turned = refs.orderBy(F.desc("CitedPublicationId"), "CitingPublicationId").repartition(3)
    for f in (C.disruption, N.cocitation, N.coupling):
        assert sorted(map(str, f(refs).collect())) == sorted(map(str, f(turned).collect()))
