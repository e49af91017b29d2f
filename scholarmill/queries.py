"""The registered queries of the library's own operators over the driver's tables, and their SQL for DuckDB.

Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.functions import arrays, text as X
from scholarmill.operators import aggregates as A, careers, citations as C, embedding, fields as FD, filters, graph, impact as I, networks as N, ranking as R, text as T
from scholarmill.operators.components import connected_components
from scholarmill.plans import model as M
from scholarmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query with its SQL, which may use the common table expressions of the model."""

    def add(f):
        key = name or f.__name__.rstrip("_")
        QUERIES[key] = f
        if sql:
            SQL[key] = f"WITH {M.CTE}{sql}" if sql.lstrip().startswith(",") else f"WITH {M.CTE} {sql}"
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def nudged(df: DataFrame, column: str) -> DataFrame:
    """A little more, as in the SQL: values like 19/128 lie between two roundings, and sums that cancel have either sign."""
    return df.withColumn(column, F.col(column) + 1e-9)


def author_years(spark: SparkSession, d: str) -> DataFrame:
    """(AuthorId, PublicationId, Year)."""
    return M.author2pub(spark, d).join(M.pub(spark, d).select("PublicationId", "Year"), "PublicationId")


def author_cites(spark: SparkSession, d: str) -> DataFrame:
    """(AuthorId, PublicationId, Ctotal) with 0 for publications that aren't cited."""
    cites = A.groupby_count(M.pub2ref(spark, d), "CitedPublicationId", "CitingPublicationId").toDF("PublicationId", "Ctotal")
    return A.with_impact(M.author2pub(spark, d), cites, "Ctotal")


AY = ", ay AS (SELECT a.AuthorId, a.PublicationId, p.Year FROM a2p a JOIN pub p USING (PublicationId))"
AC = ", ac AS (SELECT a.AuthorId, a.PublicationId, coalesce(c.n, 0) AS n FROM a2p a LEFT JOIN (SELECT b, count(*) AS n FROM e GROUP BY b) c ON c.b = a.PublicationId)"


# Impact


IMPACT = """, s AS (SELECT DISTINCT e.a, e.b FROM e JOIN a2p x ON x.PublicationId = e.a JOIN a2p y ON y.PublicationId = e.b AND x.AuthorId = y.AuthorId),
i AS (SELECT ey.b AS PublicationId, CAST(max(py) AS INTEGER) AS Year, count(*) AS Ctotal,
  count(*) FILTER (cy <= py + 5) AS C5, count(*) FILTER (cy <= py + 2) AS C2,
  count(*) FILTER (s.a IS NULL) AS Ctotal_noself, count(*) FILTER (s.a IS NULL AND cy <= py + 5) AS C5_noself, count(*) FILTER (s.a IS NULL AND cy <= py + 2) AS C2_noself
  FROM ey LEFT JOIN s ON s.a = ey.a AND s.b = ey.b WHERE cy >= py GROUP BY ey.b)"""


@query(IMPACT + " SELECT *, " + ", ".join(f"round({c} / nullif(avg({c}) OVER (PARTITION BY Year), 0), 6) AS {c}_norm" for c in ("Ctotal", "C5", "C2", "Ctotal_noself", "C5_noself", "C2_noself")) + " FROM i")
def impact(spark, d):
    out = I.load_impact(I.compute_impact(M.pub2ref(spark, d), M.pub(spark, d), M.author2pub(spark, d), (5, 2)))
    return rounded(out, *[c for c in out.columns if c.endswith("_norm")])


@query("SELECT a AS CitingPublicationId, b AS CitedPublicationId FROM e WHERE NOT EXISTS (SELECT 1 FROM a2p x JOIN a2p y ON x.AuthorId = y.AuthorId WHERE x.PublicationId = e.a AND y.PublicationId = e.b)")
def remove_selfcitations(spark, d):
    return I.remove_selfcitations(M.pub2ref(spark, d), M.author2pub(spark, d))


@query("SELECT b AS PublicationId, cy AS CitingYear, count(*) AS YearlyCitations, CAST(max(py) AS INTEGER) AS CitedYear FROM ey WHERE cy >= py GROUP BY 1, 2")
def yearly_citations(spark, d):
    return I.yearly_citations(M.pub2ref(spark, d), M.pub(spark, d))


# Aggregates


@query("SELECT b AS CitedPublicationId, count(DISTINCT a) AS CitingPublicationIdCount FROM e GROUP BY 1")
def groupby_count(spark, d):
    return A.groupby_count(M.pub2ref(spark, d), "CitedPublicationId", "CitingPublicationId")


@query(AY + " SELECT AuthorId, CAST(max(Year) - min(Year) AS INTEGER) AS YearRange FROM ay GROUP BY 1")
def groupby_range(spark, d):
    return A.groupby_range(author_years(spark, d), "AuthorId", "Year")


@query(AY + " SELECT *, CAST(Year - min(Year) OVER (PARTITION BY AuthorId) AS INTEGER) AS YearFromZero FROM ay")
def groupby_zero_col(spark, d):
    return A.groupby_zero_col(author_years(spark, d).select("AuthorId", "PublicationId", "Year"), "AuthorId", "Year")


@query("SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS l_quantityTotal FROM lineitem GROUP BY 1")
def groupby_total(spark, d):
    return A.groupby_total(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantityMean FROM lineitem GROUP BY 1")
def groupby_mean(spark, d):
    return rounded(A.groupby_mean(table(spark, d, "lineitem"), "l_suppkey", "l_quantity"), "l_quantityMean")


@query(", n AS (SELECT FieldId, count(*) AS n FROM p2f GROUP BY 1) SELECT PublicationId, FieldId FROM (SELECT p.PublicationId, p.FieldId, row_number() OVER (PARTITION BY p.PublicationId ORDER BY n DESC, p.FieldId) AS r FROM p2f p JOIN n USING (FieldId)) WHERE r = 1")
def uniquemap_by_frequency(spark, d):
    return A.uniquemap_by_frequency(M.pub2field(spark, d))


@query("SELECT AuthorId, count(*) AS Productivity FROM a2p GROUP BY 1")
def author_productivity(spark, d):
    return A.productivity(M.author2pub(spark, d))


@query("SELECT JournalId, count(DISTINCT PublicationId) AS Productivity FROM pub GROUP BY 1")
def journal_productivity(spark, d):
    return A.productivity(M.pub(spark, d), "JournalId")


@query(AY + " SELECT AuthorId, Year, count(*) AS YearlyProductivity FROM ay GROUP BY 1, 2")
def author_yearly_productivity(spark, d):
    return A.yearly_productivity(author_years(spark, d))


@query("SELECT JournalId, Year, count(DISTINCT PublicationId) AS YearlyProductivity FROM pub GROUP BY 1, 2")
def journal_yearly_productivity(spark, d):
    return A.yearly_productivity(M.pub(spark, d), "JournalId")


@query(AY + " SELECT AuthorId, CAST(max(Year) - min(Year) AS INTEGER) AS CareerLength, CAST(min(Year) AS INTEGER) AS StartYear, CAST(max(Year) AS INTEGER) AS EndYear FROM ay GROUP BY 1")
def author_career(spark, d):
    ay = author_years(spark, d)
    return A.career_length(ay).join(A.start_year(ay), "AuthorId").join(A.end_year(ay), "AuthorId")


@query(", n AS (SELECT AuthorId, FieldId, count(*) AS n FROM a2p JOIN p2f USING (PublicationId) GROUP BY 1, 2) SELECT AuthorId, FieldId AS TopFieldId FROM (SELECT *, row_number() OVER (PARTITION BY AuthorId ORDER BY n DESC, FieldId) AS r FROM n) WHERE r = 1")
def author_top_field(spark, d):
    return A.top_field(M.author2pub(spark, d).join(M.pub2field(spark, d), "PublicationId"))


@query(", k AS (SELECT PublicationId, count(DISTINCT FieldId) AS k FROM p2f GROUP BY 1), n AS (SELECT AuthorId, FieldId, round(sum(1.0::DOUBLE / k), 9) AS n FROM a2p JOIN p2f USING (PublicationId) JOIN k USING (PublicationId) GROUP BY 1, 2) SELECT AuthorId, FieldId AS TopFieldId FROM (SELECT *, row_number() OVER (PARTITION BY AuthorId ORDER BY n DESC, FieldId) AS r FROM n) WHERE r = 1")
def author_top_field_fractional(spark, d):
    return A.top_field(M.author2pub(spark, d).join(M.pub2field(spark, d), "PublicationId"), fractional=True)


@query(AC + " SELECT AuthorId, CAST(count(*) FILTER (n >= r) AS BIGINT) AS AuthorIdHindex FROM (SELECT *, row_number() OVER (PARTITION BY AuthorId ORDER BY n DESC) AS r FROM ac) GROUP BY 1")
def author_hindex(spark, d):
    return A.hindex(author_cites(spark, d), "AuthorId", "Ctotal")


@query(", jc AS (SELECT p.JournalId, coalesce(c.n, 0) AS n FROM pub p LEFT JOIN (SELECT b, count(*) AS n FROM e GROUP BY b) c ON c.b = p.PublicationId) SELECT JournalId, CAST(count(*) FILTER (n >= r) AS BIGINT) AS JournalIdHindex FROM (SELECT *, row_number() OVER (PARTITION BY JournalId ORDER BY n DESC) AS r FROM jc) GROUP BY 1")
def journal_hindex(spark, d):
    cites = A.groupby_count(M.pub2ref(spark, d), "CitedPublicationId", "CitingPublicationId").toDF("PublicationId", "Ctotal")
    return A.hindex(A.with_impact(M.pub(spark, d), cites, "Ctotal"), "JournalId", "Ctotal")


G = AC + ", g AS (SELECT AuthorId, row_number() OVER w AS r, sum(n) OVER w AS s FROM ac WINDOW w AS (PARTITION BY AuthorId ORDER BY n DESC ROWS UNBOUNDED PRECEDING)) SELECT AuthorId, CAST(count(*) FILTER ({}) AS BIGINT) AS AuthorIdGindex FROM g GROUP BY 1"


@query(G.format("s >= r * r"))
def gindex_paper(spark, d):
    return A.gindex(author_cites(spark, d), "AuthorId", "Ctotal")


@query(G.format("s > (r - 1) * (r - 1)"))
def gindex_reference(spark, d):
    return A.gindex(author_cites(spark, d), "AuthorId", "Ctotal", "reference")


@query(AC + " SELECT AuthorId, round(exp(avg(ln(n)) FILTER (n > 0)), 6) AS AuthorIdQfactor, max(n) AS AuthorIdCindex, count(*) FILTER (n > 0) AS AuthorIdPindex FROM (SELECT AuthorId, n FROM ac) GROUP BY 1".replace("avg(ln(n)) FILTER (n > 0)", "avg(CASE WHEN n > 0 THEN ln(n) END)"))
def qcp_index(spark, d):
    ac = author_cites(spark, d)
    return rounded(A.qfactor(ac, "AuthorId", "Ctotal").join(A.cindex(ac, "AuthorId", "Ctotal"), "AuthorId").join(A.pindex(ac, "AuthorId", "Ctotal"), "AuthorId"), "AuthorIdQfactor")


@query(""", it AS (SELECT JournalId, y AS Year, count(*) AS n FROM (SELECT JournalId, unnest(range(Year + 1, Year + 3)) AS y FROM pub) WHERE y <= (SELECT max(Year) FROM pub) GROUP BY 1, 2),
h AS (SELECT q.JournalId, p.Year, count(*) AS n FROM e JOIN pub p ON p.PublicationId = e.a JOIN pub q ON q.PublicationId = e.b WHERE p.Year > q.Year AND p.Year <= q.Year + 2 GROUP BY 1, 2)
SELECT it.JournalId, CAST(it.Year AS INTEGER) AS Year, round(coalesce(h.n, 0) / it.n, 6) AS ImpactFactor2 FROM it LEFT JOIN h ON h.JournalId = it.JournalId AND h.Year = it.Year""")
def journal_impactfactor(spark, d):
    return rounded(A.impact_factor(M.pub(spark, d), M.pub2ref(spark, d), 2), "ImpactFactor2")


@query("SELECT PublicationId, max(AuthorSequence) AS TeamSize FROM paa GROUP BY 1")
def team_size(spark, d):
    return A.team_size(M.paa(spark, d))


@query("SELECT FieldId, row_number() OVER (ORDER BY FieldId) - 1 AS Code FROM (SELECT DISTINCT FieldId FROM p2f)")
def value_to_int(spark, d):
    return A.value_to_int(M.pub2field(spark, d), "FieldId").withColumn("Code", F.col("Code").cast("long"))


@query(""", n AS (SELECT AuthorId, FieldId, count(*) AS n FROM a2p JOIN p2f USING (PublicationId) GROUP BY 1, 2)
SELECT AuthorId, round(sum(n * n)::DOUBLE / (sum(n) * sum(n)), 6) AS FieldIdSimpson, round(sum(n * (n - 1))::DOUBLE / nullif(sum(n) * (sum(n) - 1), 0), 6) AS Finite, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS FieldIdEntropy FROM n GROUP BY 1""")
def diversity_of_groups(spark, d):
    x = M.author2pub(spark, d).join(M.pub2field(spark, d), "PublicationId")
    out = A.simpson("AuthorId", "FieldId", x).join(A.simpson("AuthorId", "FieldId", x, True).toDF("AuthorId", "Finite"), "AuthorId").join(A.shannon("AuthorId", "FieldId", x), "AuthorId")
    return rounded(out, "FieldIdSimpson", "Finite", "FieldIdEntropy")


@query(AC + """, x AS (SELECT AuthorId, n, row_number() OVER (PARTITION BY AuthorId ORDER BY n) AS i FROM ac)
SELECT AuthorId, round((2 * sum(i * n) - (count(*) + 1) * sum(n))::DOUBLE / nullif(count(*) * sum(n), 0), 6) AS CtotalGini, round(sqrt(avg(n * n)), 6) AS CtotalHolder FROM x GROUP BY 1""")
def gini_holder(spark, d):
    ac = author_cites(spark, d)
    return rounded(A.gini(ac, "AuthorId", "Ctotal").join(A.holder_mean(ac, "AuthorId", "Ctotal", 2.0), "AuthorId"), "CtotalGini", "CtotalHolder")


# Ranking and statistics


RANKED = ", c AS (SELECT b AS PublicationId, CAST(max(py) AS INTEGER) AS Year, count(*) AS Ctotal FROM ey WHERE cy >= py GROUP BY 1)"


def _cited(spark, d):
    return I.compute_impact(M.pub2ref(spark, d), M.pub(spark, d), None, ())


@query(RANKED + " SELECT *, round((row_number() OVER (PARTITION BY Year ORDER BY Ctotal, PublicationId) - 1) / nullif(count(*) OVER (PARTITION BY Year) - 1, 0), 6) AS CtotalRank FROM c")
def citation_rank(spark, d):
    return rounded(R.citation_rank(_cited(spark, d), column="Ctotal", normed=True), "CtotalRank")


@query(RANKED + " SELECT PublicationId, Year, Ctotal, coalesce((row_number() OVER (PARTITION BY Year ORDER BY Ctotal, PublicationId) - 1) / nullif(count(*) OVER (PARTITION BY Year) - 1, 0) >= 0.95, false) AS Hit FROM c")
def hit_papers(spark, d):
    return R.hit_papers(_cited(spark, d), column="Ctotal")


@query(RANKED + " SELECT PublicationId, FieldId, Year, round((row_number() OVER (PARTITION BY Year, FieldId ORDER BY Ctotal, PublicationId) - 1) / nullif(count(*) OVER (PARTITION BY Year, FieldId) - 1, 0), 6) AS CtotalRank FROM c JOIN p2f USING (PublicationId)")
def field_rank(spark, d):
    return rounded(R.field_rank(_cited(spark, d), M.pub2field(spark, d), ["Ctotal"]), "CtotalRank")


AUC = """, o AS (SELECT c_nationkey AS g, o_totalprice AS v, o_orderstatus = 'F' AS x FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2 AS r, rank() OVER (PARTITION BY g, x ORDER BY v) + (count(*) OVER (PARTITION BY g, x, v) - 1) / 2 AS own,
  count(*) FILTER (x) OVER (PARTITION BY g) AS nm, count(*) FILTER (NOT x) OVER (PARTITION BY g) AS nn FROM o)"""


def _prices(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("g"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("x"))


@query(AUC + " SELECT g, round((sum(r) FILTER (x) - max(nm) * (max(nm) + 1) / 2) / nullif(max(nm) * max(nn), 0), 6) AS AUC FROM m GROUP BY g")
def fast_auc(spark, d):
    return rounded(R.auc(_prices(spark, d), "g", "v", "x"), "AUC")


@query(AUC + """, w AS (SELECT g, x, CASE WHEN x THEN (r - own) / nullif(nn, 0) ELSE 1 - (r - own) / nullif(nm, 0) END AS v FROM m),
q AS (SELECT g, avg(v) FILTER (x) AS auc, var_samp(v) FILTER (x) / count(*) FILTER (x) + var_samp(v) FILTER (NOT x) / count(*) FILTER (NOT x) AS var FROM w GROUP BY g)
SELECT g, round(CASE WHEN var IS NOT NULL THEN auc END, 6) AS AUC, round(var, 6) AS Variance, round((auc - 0.5) / nullif(sqrt(var), 0), 6) AS Z FROM q""")
def fast_delong(spark, d):
    return rounded(R.delong(_prices(spark, d), "g", "v", "x"), "AUC", "Variance", "Z")


@query(""", t AS (SELECT s_suppkey AS id, s_nationkey AS g, abs(s_acctbal) / 1000000.0::DOUBLE AS p FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM t),
s AS (SELECT *, min(CASE WHEN p > 0.05 / (n - r + 1) THEN r END) OVER (PARTITION BY g) AS stop FROM k) SELECT id, g, p, r < coalesce(stop, n + 1) AS Reject FROM s""")
def holm_correction(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), (F.abs("s_acctbal") / 1000000.0).alias("p"))
    return R.holm(t, "p", ["g"], "id")


@query(", r AS (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT user_id, event_id, round(CASE WHEN n = 5 THEN m END, 6) AS WindowMean FROM r")
def rolling_window(spark, d):
    x = R.rolling(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 5, "centred")
    return rounded(x.select("user_id", "event_id", (F.aggregate("Window", F.lit(0.0), lambda s, v: s + v) / 5).alias("WindowMean")), "WindowMean")


@query(" SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r <= 5")
def argtopk(spark, d):
    return R.top_k(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 5)


@query(""", r AS (SELECT user_id, row_number() OVER w - 1 AS p, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(p AS INTEGER) AS Position FROM r WHERE new UNION ALL SELECT user_id, CAST(count(*) AS INTEGER) FROM events GROUP BY 1""")
def changepoint(spark, d):
    return R.change_points(table(spark, d, "events"), "user_id", "event_id", "event_type")


# Networks


@query("SELECT l_orderkey AS \"row\", l_partkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2")
def bipartite(spark, d):
    return N.bipartite(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), "l_quantity"), "row", "col", "l_quantity")


@query("SELECT x.AuthorId AS src, y.AuthorId AS dst, CAST(count(*) AS BIGINT) AS weight FROM a2p x JOIN a2p y ON x.PublicationId = y.PublicationId AND x.AuthorId < y.AuthorId GROUP BY 1, 2")
def coauthorship(spark, d):
    return N.coauthorship(M.paa(spark, d))


EGO = ", f AS (SELECT s_suppkey AS AuthorId FROM supplier WHERE s_nationkey = 3), m AS (SELECT * FROM a2p SEMI JOIN f USING (AuthorId)), o AS (SELECT * FROM a2p SEMI JOIN m USING (PublicationId)), g AS (SELECT * FROM a2p SEMI JOIN o USING (AuthorId)) SELECT x.AuthorId AS src, y.AuthorId AS dst, CAST(count(*) AS BIGINT) AS weight FROM {0} x JOIN {0} y ON x.PublicationId = y.PublicationId AND x.AuthorId < y.AuthorId GROUP BY 1, 2"


def _focus(spark, d):
    return table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("AuthorId"))


for _kind, _rows in (("authors", "m"), ("publications", "o"), ("ego", "g")):
    query(EGO.format(_rows), f"coauthorship_focus_{_kind}")(lambda spark, d, kind=_kind: N.coauthorship(M.paa(spark, d), _focus(spark, d), kind))


@query("SELECT x.AuthorId AS src, y.AuthorId AS dst, p.Year, CAST(count(*) AS BIGINT) AS weight FROM a2p x JOIN a2p y ON x.PublicationId = y.PublicationId AND x.AuthorId < y.AuthorId JOIN pub p ON p.PublicationId = x.PublicationId GROUP BY 1, 2, 3")
def coauthorship_temporal(spark, d):
    return N.coauthorship(author_years(spark, d), year="Year")


@query("SELECT x.b AS src, y.b AS dst, CAST(count(*) AS BIGINT) AS weight FROM e x JOIN e y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2")
def cocitation(spark, d):
    return N.cocitation(M.pub2ref(spark, d))


@query(", f AS (SELECT DISTINCT a FROM e WHERE b IN (SELECT p_partkey FROM part WHERE p_size = 7)) SELECT x.b AS src, y.b AS dst, CAST(count(*) AS BIGINT) AS weight FROM e x JOIN e y ON x.a = y.a AND x.b < y.b WHERE x.a IN (FROM f) GROUP BY 1, 2")
def cocitation_egocited(spark, d):
    return N.cocitation(M.pub2ref(spark, d), table(spark, d, "part").where("p_size = 7").select("p_partkey"), "egocited")


@query("SELECT x.a AS src, y.a AS dst, CAST(count(*) AS BIGINT) AS weight FROM e x JOIN e y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2")
def coupling(spark, d):
    return N.coupling(M.pub2ref(spark, d))


@query(""", p AS (SELECT DISTINCT x.cy, x.b, y.b AS o FROM ey x JOIN ey y ON x.a = y.a AND x.b <> y.b), n AS (SELECT cy, b, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT cy, b, count(*) AS c FROM ey GROUP BY 1, 2)
SELECT c.cy AS CitingYear, c.b AS PublicationId, CAST(coalesce(n, 0) AS BIGINT) AS Neighbours, CAST(c AS BIGINT) AS Citations FROM c LEFT JOIN n ON n.cy = c.cy AND n.b = c.b""")
def temporal_cocitation(spark, d):
    return N.temporal_cocitation(M.dated_refs(spark, d))


@query("SELECT a AS src, b AS dst FROM e WHERE a IN (SELECT PublicationId FROM pub WHERE Year = 1997) AND b IN (SELECT PublicationId FROM pub WHERE Year = 1997)")
def citation_edgelist(spark, d):
    return N.citation_edges(M.pub2ref(spark, d), M.pub(spark, d).where("Year = 1997"))


BACKBONE = """, w AS (SELECT x.b AS src, y.b AS dst, count(*) AS weight FROM e x JOIN e y ON x.a = y.a AND x.b <> y.b GROUP BY 1, 2),
s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY src) AS p, count(*) OVER (PARTITION BY src) AS k FROM w) """


@query(BACKBONE + "SELECT src, dst, CAST(weight AS BIGINT) AS weight FROM s WHERE p < 1 AND pow(1 - p, k - 1) < 0.2")
def multiscale_backbone(spark, d):
    return N.backbone(N.directed(N.cocitation(M.pub2ref(spark, d))), 0.2)


@query(""", r AS (SELECT PublicationId, AuthorId, p.Year, AffiliationId FROM (SELECT l_orderkey AS PublicationId, l_partkey AS AuthorId, s_nationkey AS AffiliationId FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) JOIN pub p USING (PublicationId)),
k AS (SELECT *, lag(AffiliationId) OVER (PARTITION BY AuthorId ORDER BY Year, PublicationId, AffiliationId) AS b FROM r), m AS (SELECT *, lead(AffiliationId) OVER (PARTITION BY AuthorId ORDER BY Year, PublicationId, AffiliationId) AS n FROM k WHERE b IS NULL OR b <> AffiliationId)
SELECT AffiliationId AS src, n AS dst, count(*) AS weight FROM m WHERE n IS NOT NULL GROUP BY 1, 2""")
def trajectory_network(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    moves = items.select(F.col("l_orderkey").alias("PublicationId"), F.col("l_partkey").alias("AuthorId"), F.col("s_nationkey").alias("AffiliationId")).join(M.pub(spark, d).select("PublicationId", "Year"), "PublicationId")
    return N.mobility(N.trajectory(moves))


COMPONENTS = ", g AS (SELECT s_suppkey AS v, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS c FROM supplier) "


def _nation_chains(spark, d):
    """Suppliers of a nation, each linked to the next."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.coalesce(F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")), F.col("s_suppkey")).alias("dst"))
    return s


@query(COMPONENTS + "SELECT v AS vertex, c AS component FROM g")
def connected_components_(spark, d):
    return connected_components(_nation_chains(spark, d))


@query(COMPONENTS + ", z AS (SELECT c, count(*) AS n FROM g GROUP BY 1) SELECT v AS vertex FROM g WHERE c = (SELECT c FROM z ORDER BY n DESC, c LIMIT 1)")
def largest_component(spark, d):
    return N.largest_component(_nation_chains(spark, d))


NATIONS = ", ne AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"


def _trade(spark, d):
    """Trade between nations."""
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("weight"))


def _loop_sql(step: str, rounds: int, first: str) -> str:
    parts, last = [], first
    for i in range(1, rounds + 1):
        parts.append(f"x{i} AS MATERIALIZED ({step.replace('PREVIOUS', last)})")
        last = f"x{i}"
    return ", ".join(parts)


@query(NATIONS + """, sh AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM ne), vs AS MATERIALIZED (SELECT src AS v FROM ne UNION SELECT dst FROM ne), nn AS (SELECT count(*) AS n FROM vs),
x0 AS MATERIALIZED (SELECT v, 1.0::DOUBLE / n AS x FROM vs, nn), """ + _loop_sql("SELECT vs.v, 0.85 * (coalesce(f.x, 0) + coalesce(l.x, 0) / n) + 0.15 / n AS x FROM vs CROSS JOIN nn LEFT JOIN (SELECT dst, sum(p.x * w) AS x FROM sh JOIN PREVIOUS p ON p.v = sh.src GROUP BY 1) f ON f.dst = vs.v CROSS JOIN (SELECT sum(x) AS x FROM PREVIOUS WHERE v NOT IN (SELECT src FROM ne)) l", 20, "x0") + " SELECT v AS vertex, round(x, 6) AS PageRank FROM x20")
def pagerank(spark, d):
    return rounded(graph.pagerank(_trade(spark, d), max_iter=20, tol=None), "PageRank")


@query(NATIONS + ", vs AS MATERIALIZED (SELECT src AS v FROM ne UNION SELECT dst FROM ne), x0 AS MATERIALIZED (SELECT v, 1.0::DOUBLE / count(*) OVER () AS x FROM vs), " + _loop_sql("SELECT vs.v, coalesce(f.x, 0) / sqrt(sum(f.x * f.x) OVER ()) AS x FROM vs LEFT JOIN (SELECT dst, sum(p.x * weight) AS x FROM ne JOIN PREVIOUS p ON p.v = ne.src GROUP BY 1) f ON f.dst = vs.v", 20, "x0") + " SELECT v AS vertex, round(x, 6) AS Centrality FROM x20")
def eigenvector_centrality(spark, d):
    return rounded(graph.eigenvector(_trade(spark, d), 20, None), "Centrality")


@query(""", k AS (SELECT *, count(*) OVER (PARTITION BY PublicationId) AS n FROM a2p), ne AS MATERIALIZED (SELECT x.AuthorId AS src, y.AuthorId AS dst, sum(1.0::DOUBLE / (x.n * y.n)) AS weight FROM e JOIN k x ON x.PublicationId = e.a JOIN k y ON y.PublicationId = e.b GROUP BY 1, 2),
sh AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM ne), st AS MATERIALIZED (SELECT AuthorId AS v, sum(1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM k) AS p FROM k GROUP BY 1), x0 AS (SELECT v, p AS x FROM st), """ + _loop_sql("SELECT st.v, 0.9 * (coalesce(f.x, 0) + coalesce(l.x, 0) * p) + 0.1 * p AS x FROM st LEFT JOIN (SELECT dst, sum(q.x * w) AS x FROM sh JOIN PREVIOUS q ON q.v = sh.src GROUP BY 1) f ON f.dst = st.v CROSS JOIN (SELECT sum(x) AS x FROM PREVIOUS WHERE v NOT IN (SELECT src FROM ne)) l", 10, "x0") + " SELECT v AS vertex, round(x, 6) AS PageRank FROM x10")
def diffusion_of_scientific_credit(spark, d):
    return rounded(graph.scientific_credit(M.pub2ref(spark, d), M.author2pub(spark, d), max_iter=10, tol=None), "PageRank")


@query(NATIONS + " SELECT src, dst, weight, round((weight / sum(weight) OVER (PARTITION BY src)) / nullif(sum(weight) OVER (PARTITION BY dst) / nullif(sum(weight) OVER () - sum(weight) OVER (PARTITION BY src), 0), 0), 6) AS Normalised FROM ne")
def schubert_glanzel(spark, d):
    return rounded(N.schubert_glanzel(_trade(spark, d)), "Normalised")


@query(NATIONS + ", m AS (SELECT n_nationkey AS v, n_regionkey AS c FROM nation), z AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT a.c AS src_community, b.c AS dst_community, round(sum(weight) / (max(p.n) * max(q.n)), 6) AS Density FROM ne JOIN m a ON a.v = src JOIN m b ON b.v = dst JOIN z p ON p.c = a.c JOIN z q ON q.c = b.c GROUP BY 1, 2")
def block_density(spark, d):
    return rounded(N.block_density(_trade(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("vertex"), F.col("n_regionkey").alias("community"))), "Density")


@query(NATIONS + """, m AS (SELECT n_nationkey AS v, n_regionkey AS c FROM nation), b AS (SELECT src, dst, weight FROM ne UNION ALL SELECT dst, src, weight FROM ne), k AS (SELECT c, sum(weight) AS k FROM b JOIN m ON m.v = src GROUP BY 1),
t AS (SELECT sum(k) AS m2, sum(k * k) AS k2, (SELECT sum(weight) FROM b JOIN m x ON x.v = src JOIN m y ON y.v = dst WHERE x.c = y.c) AS i FROM k), w AS (SELECT i / (k2 / m2) AS wi, (m2 - i) / (m2 - k2 / m2) AS wo FROM t)
SELECT round(wi, 6) AS omega_in, round(wo, 6) AS omega_out, round((wi - wo) / (ln(wi) - ln(wo)), 6) AS gamma FROM w""")
def estimate_resolution(spark, d):
    return rounded(N.estimate_resolution(_trade(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("vertex"), F.col("n_regionkey").alias("community"))), "omega_in", "omega_out", "gamma")


# Fields


VECTORS = """, k AS (SELECT PublicationId AS p, FieldId AS f, 1.0::DOUBLE / count(*) OVER (PARTITION BY PublicationId) AS w FROM p2f), v AS (SELECT x.f AS SourceFieldId, y.f AS TargetFieldId, sum(x.w * y.w) AS Weight FROM e JOIN k x ON x.p = e.a JOIN k y ON y.p = e.b GROUP BY 1, 2)"""
FIELD_COUNTS = ", n AS (SELECT a AS PublicationId, FieldId, count(*) AS n FROM e JOIN p2f ON p2f.PublicationId = e.b GROUP BY 1, 2)"


@query(FIELD_COUNTS + " SELECT PublicationId, round(1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)), 6) AS SimpsonInterdisciplinarity FROM n GROUP BY 1")
def simpson_interdisciplinarity(spark, d):
    return rounded(FD.simpson_interdisciplinarity(M.pub2ref(spark, d), M.pub2field(spark, d)), "SimpsonInterdisciplinarity")


@query(FIELD_COUNTS.replace("a AS Pub", "b AS Pub").replace("= e.b", "= e.a") + " SELECT PublicationId, round(1 - sum(n * (n - 1))::DOUBLE / nullif(sum(n) * (sum(n) - 1), 0), 6) AS SimpsonInterdisciplinarity FROM n GROUP BY 1")
def simpson_finite_citations(spark, d):
    return rounded(FD.simpson_interdisciplinarity(M.pub2ref(spark, d), M.pub2field(spark, d), "citations", True), "SimpsonInterdisciplinarity")


@query(FIELD_COUNTS + " SELECT PublicationId, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln((SELECT count(DISTINCT FieldId) FROM p2f)), 6) + 0.0 AS ShannonInterdisciplinarity FROM n GROUP BY 1")
def shannon_interdisciplinarity(spark, d):
    return rounded(FD.shannon_interdisciplinarity(M.pub2ref(spark, d), M.pub2field(spark, d), normalised=True), "ShannonInterdisciplinarity").withColumn("ShannonInterdisciplinarity", F.col("ShannonInterdisciplinarity") + 0.0)


@query(VECTORS + " SELECT SourceFieldId, TargetFieldId, round(Weight / sum(Weight) OVER (PARTITION BY TargetFieldId), 6) AS Weight FROM v")
def field_citation_vectors(spark, d):
    return rounded(FD.field_citation_vectors(M.pub2ref(spark, d), M.pub2field(spark, d), normalise="target"), "Weight")


@query(VECTORS + " SELECT SourceFieldId, TargetFieldId, round(Weight / sum(Weight) OVER (PARTITION BY SourceFieldId), 6) AS Share FROM v")
def field_citation_share(spark, d):
    return rounded(FD.field_citation_share(M.pub2ref(spark, d), M.pub2field(spark, d)), "Share")


YEAR_VECTORS = VECTORS.replace("SELECT x.f AS S", "SELECT e.cy AS CitingYear, x.f AS S").replace("FROM e JOIN", "FROM ey e JOIN").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")


@query(YEAR_VECTORS + " SELECT SourceFieldId, TargetFieldId, CitingYear, round(Weight / sum(Weight) OVER (PARTITION BY CitingYear, SourceFieldId), 6) AS Share FROM v")
def field_citation_share_temporal(spark, d):
    return rounded(FD.field_citation_share(M.dated_refs(spark, d), M.pub2field(spark, d), year="CitingYear"), "Share")


@query(VECTORS + ", r AS (SELECT FieldId, count(*) AS n FROM p2f GROUP BY 1) SELECT SourceFieldId, TargetFieldId, round(Weight / sum(Weight) OVER (PARTITION BY SourceFieldId) / (n / (SELECT sum(n) FROM r)), 6) AS Strength FROM v JOIN r ON r.FieldId = TargetFieldId")
def field_citation_strength(spark, d):
    return rounded(FD.field_citation_strength(M.pub2ref(spark, d), M.pub2field(spark, d), M.pub(spark, d)), "Strength")


@query(YEAR_VECTORS + """, r AS (SELECT FieldId, Year, count(*) AS n FROM p2f JOIN pub USING (PublicationId) GROUP BY 1, 2), u AS (SELECT FieldId, y, sum(n) AS n FROM r JOIN (SELECT DISTINCT CitingYear AS y FROM v) ON Year <= y GROUP BY 1, 2), b AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS s FROM u)
SELECT SourceFieldId, TargetFieldId, CitingYear, round(Weight / sum(Weight) OVER (PARTITION BY CitingYear, SourceFieldId) / s, 6) AS Strength FROM v JOIN b ON b.FieldId = TargetFieldId AND b.y = CitingYear""")
def field_citation_strength_temporal(spark, d):
    return rounded(FD.field_citation_strength(M.dated_refs(spark, d), M.pub2field(spark, d), M.pub(spark, d), year="CitingYear"), "Strength")


DISTANCE = VECTORS + """, f AS (SELECT DISTINCT FieldId FROM p2f), q AS (SELECT SourceFieldId AS s, sqrt(sum(Weight * Weight)) AS q FROM v GROUP BY 1),
dt AS (SELECT x.SourceFieldId AS i, y.SourceFieldId AS j, sum(x.Weight * y.Weight) AS dt FROM v x JOIN v y ON x.TargetFieldId = y.TargetFieldId AND x.SourceFieldId < y.SourceFieldId GROUP BY 1, 2),
fd AS (SELECT i.FieldId AS iFieldId, j.FieldId AS jFieldId, 1 - coalesce(dt / (a.q * b.q), 0) AS FieldDistance FROM f i JOIN f j ON i.FieldId < j.FieldId LEFT JOIN dt ON dt.i = i.FieldId AND dt.j = j.FieldId LEFT JOIN q a ON a.s = i.FieldId LEFT JOIN q b ON b.s = j.FieldId)"""


@query(DISTANCE + " SELECT iFieldId, jFieldId, round(FieldDistance, 6) AS FieldDistance FROM fd WHERE abs(FieldDistance) > 1e-12")
def field_citation_distance(spark, d):
    return rounded(FD.field_citation_distance(M.pub2ref(spark, d), M.pub2field(spark, d)), "FieldDistance")


@query(DISTANCE + """, sh AS (SELECT a AS p, f, sum(w) AS w FROM e JOIN k ON k.p = e.b GROUP BY 1, 2), ps AS (SELECT p, f, w / sum(w) OVER (PARTITION BY p) AS s FROM sh), r AS (SELECT x.p, sum(x.s * y.s * FieldDistance) AS r FROM ps x JOIN ps y ON x.p = y.p JOIN fd ON iFieldId = x.f AND jFieldId = y.f GROUP BY 1)
SELECT DISTINCT sh.p AS PublicationId, round(coalesce(r, 0), 6) AS RaoStirling FROM sh LEFT JOIN r ON r.p = sh.p""")
def raostirling_interdisciplinarity(spark, d):
    return rounded(FD.raostirling(M.pub2ref(spark, d), M.pub2field(spark, d)), "RaoStirling")


# Single publications


DISRUPTION = """, s AS (SELECT DISTINCT f.a AS focus, c.a AS citer FROM e f JOIN e c ON c.b = f.b {}), j AS (SELECT e.b AS focus, count(*) AS nf, count(s.citer) AS nj FROM e LEFT JOIN s ON s.focus = e.b AND s.citer = e.a GROUP BY 1), r AS (SELECT focus, count(*) AS ns FROM s GROUP BY 1)
SELECT j.focus AS PublicationId, round(CASE WHEN j.focus IN (SELECT a FROM e) THEN (nf - 2 * nj) / (nf - nj + coalesce(ns, 0)) END, 6) AS Disruption FROM j LEFT JOIN r ON r.focus = j.focus"""


@query(DISRUPTION.format("WHERE f.a <> c.a"))
def disruption_paper(spark, d):
    return rounded(C.disruption(M.pub2ref(spark, d)), "Disruption")


@query(DISRUPTION.format(""))
def disruption_reference(spark, d):
    return rounded(C.disruption(M.pub2ref(spark, d), mode="reference"), "Disruption")


@query(""", o AS (SELECT * FROM ey WHERE cy BETWEEN py AND py + 5), c AS (SELECT b, cy, count(*) AS n FROM ey GROUP BY 1, 2), r AS (SELECT DISTINCT o.b AS f, o.cy, e.b FROM o JOIN e ON e.a = o.a AND e.b <> o.b), m AS (SELECT f, r.cy, avg(n) AS m FROM r JOIN c ON c.b = r.b AND c.cy = r.cy GROUP BY 1, 2),
w AS (SELECT b, cy, count(*) AS n, max(py) AS py FROM o GROUP BY 1, 2) SELECT w.b AS PublicationId, CAST(max(py) AS INTEGER) AS CitedYear, round(coalesce(sum(n / m), 0), 6) AS Cnorm5 FROM w LEFT JOIN m ON m.f = w.b AND m.cy = w.cy GROUP BY 1""")
def netnormcite(spark, d):
    return rounded(C.netnormcite(M.dated_refs(spark, d), 5), "Cnorm5")


@query(""", j AS (SELECT PublicationId, Year, JournalId AS j FROM pub), rf AS (SELECT e.a, e.b, x.Year AS cy, y.Year AS py, y.j FROM e JOIN j x ON x.PublicationId = e.a JOIN j y ON y.PublicationId = e.b),
ev AS (SELECT x.cy, x.a, least(x.j, y.j) AS j1, greatest(x.j, y.j) AS j2 FROM rf x JOIN rf y ON x.cy = y.cy AND x.a = y.a AND x.b < y.b), ob AS (SELECT cy, j1, j2, count(*) AS n FROM ev GROUP BY 1, 2, 3),
sm AS (SELECT unnest(range(1, 11)) AS s), mn AS (SELECT s, cy, py, a, b, j, row_number() OVER (PARTITION BY s, cy, py ORDER BY a, b) AS rn, row_number() OVER (PARTITION BY s, cy, py ORDER BY md5(concat(CAST(s AS VARCHAR), ':', CAST(a AS VARCHAR), ':', CAST(b AS VARCHAR))), a, b) AS rs FROM rf CROSS JOIN sm),
mx AS (SELECT x.s, x.cy, x.a, x.b, y.j FROM mn x JOIN mn y ON x.s = y.s AND x.cy = y.cy AND x.py = y.py AND x.rn = y.rs), np AS (SELECT x.s, x.cy, least(x.j, y.j) AS j1, greatest(x.j, y.j) AS j2, count(*) AS n FROM mx x JOIN mx y ON x.s = y.s AND x.cy = y.cy AND x.a = y.a AND x.b < y.b GROUP BY 1, 2, 3, 4),
nl AS (SELECT cy, j1, j2, sum(n) / 10 AS m, sum(n * n) / 10 AS q FROM np GROUP BY 1, 2, 3), z AS (SELECT ob.cy, ob.j1, ob.j2, CASE WHEN q - m * m > 1e-12 THEN (n - m) / sqrt(q - m * m) END AS z FROM ob JOIN nl USING (cy, j1, j2))
SELECT a AS PublicationId, round(quantile_cont(z, 0.1), 6) AS Novelty, round(quantile_cont(z, 0.5), 6) AS Conventionality FROM ev JOIN z USING (cy, j1, j2) GROUP BY 1""")
def novelty_conventionality(spark, d):
    return rounded(C.novelty(M.pub(spark, d), M.pub2ref(spark, d)), "Novelty", "Conventionality")


CREDIT = """, k AS (SELECT PublicationId AS p, AuthorId, count(*) OVER (PARTITION BY PublicationId) AS n FROM a2p), w AS (SELECT x.b AS f, y.b AS p, count(*) AS s FROM e x JOIN e y ON x.a = y.a GROUP BY 1, 2),
r AS (SELECT w.f AS PublicationId, m.AuthorId, sum(s / k.n) AS raw FROM w JOIN a2p m ON m.PublicationId = w.f JOIN k ON k.p = w.p AND k.AuthorId = m.AuthorId GROUP BY 1, 2)"""


@query(CREDIT + " SELECT PublicationId, AuthorId, round(raw / sum(raw) OVER (PARTITION BY PublicationId) + 1e-9, 6) AS CreditShare FROM r")
def credit_share(spark, d):
    return rounded(nudged(C.credit_share(M.pub2ref(spark, d), M.author2pub(spark, d)), "CreditShare"), "CreditShare")


@query(""", k AS (SELECT PublicationId AS p, AuthorId, count(*) OVER (PARTITION BY PublicationId) AS n FROM a2p), w AS (SELECT x.b AS f, y.b AS p, x.cy, count(*) AS s FROM ey x JOIN e y ON x.a = y.a GROUP BY 1, 2, 3),
r AS (SELECT w.f, m.AuthorId, w.cy, sum(s / k.n) AS raw FROM w JOIN a2p m ON m.PublicationId = w.f JOIN k ON k.p = w.p AND k.AuthorId = m.AuthorId GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT b AS f, cy, m.AuthorId FROM ey JOIN a2p m ON m.PublicationId = ey.b), c AS (SELECT g.f, g.AuthorId, g.cy, sum(coalesce(raw, 0)) OVER (PARTITION BY g.f, g.AuthorId ORDER BY g.cy) AS raw FROM g LEFT JOIN r ON r.f = g.f AND r.cy = g.cy AND r.AuthorId = g.AuthorId)
SELECT f AS PublicationId, AuthorId, cy AS CitingYear, round(raw / sum(raw) OVER (PARTITION BY f, cy) + 1e-9, 6) AS CreditShare FROM c""")
def credit_share_temporal(spark, d):
    out = C.credit_share(M.dated_refs(spark, d), M.author2pub(spark, d), year="CitingYear")
    return rounded(nudged(out, "CreditShare"), "CreditShare")


BEAUTY = """, n AS (SELECT b, cy, count(*) AS n FROM ey GROUP BY 1, 2), sp AS (SELECT b, min(cy) AS y0, max(cy) AS y1 FROM n GROUP BY 1), u AS (SELECT b, y0, unnest(range(y0, y1 + 1)) AS y FROM sp),
fl AS (SELECT u.b, u.y, u.y - y0 AS t, {} AS c FROM u LEFT JOIN n ON n.b = u.b AND n.cy = u.y), tp AS (SELECT b, max(c) AS cm, min_by(t, -c * 100000 + t) AS tm, min_by(c, t) AS c0 FROM fl GROUP BY 1),
x AS (SELECT fl.*, cm, tm, c0, (cm - c0) * t / nullif(tm, 0) + c0 AS l, abs((cm - c0) * t - tm * c + tm * c0) AS far FROM fl JOIN tp USING (b) WHERE t <= tm)
SELECT b AS PublicationId, round(sum((l - c) / greatest(1, c)) + 1e-9, 6) AS BeautyCoefficient, CAST(min_by(y, -far * 100000 + t) AS INTEGER) AS Awakening FROM x GROUP BY 1"""


@query(BEAUTY.format("coalesce(n, 0)"))
def sleeping_beauty_paper(spark, d):
    return rounded(nudged(C.publication_beauty(M.dated_refs(spark, d)), "BeautyCoefficient"), "BeautyCoefficient")


@query(BEAUTY.format("greatest(coalesce(n, 0), 1)"))
def sleeping_beauty_reference(spark, d):
    return rounded(nudged(C.publication_beauty(M.dated_refs(spark, d), "reference"), "BeautyCoefficient"), "BeautyCoefficient")


PIVOT = """, r AS (SELECT e.a, q.JournalId AS j FROM e JOIN pub q ON q.PublicationId = e.b), v AS (SELECT a, j, count(*) AS n FROM r GROUP BY 1, 2), sq AS (SELECT a.AuthorId, p.PublicationId, p.Year, row_number() OVER (PARTITION BY a.AuthorId ORDER BY p.Year, p.PublicationId) AS i FROM (SELECT DISTINCT l_partkey AS AuthorId, l_orderkey AS PublicationId FROM lineitem) a JOIN pub p USING (PublicationId)),
w AS (SELECT sq.*, v.j, v.n FROM sq JOIN v ON v.a = sq.PublicationId), h AS (SELECT s.AuthorId, s.PublicationId, w.j, sum(w.n) AS n FROM sq s JOIN w ON w.AuthorId = s.AuthorId AND w.i < s.i {} GROUP BY 1, 2, 3), qb AS (SELECT AuthorId, PublicationId, sum(n * n) AS q FROM h GROUP BY 1, 2), qa AS (SELECT a, sum(n * n) AS q FROM v GROUP BY 1),
dt AS (SELECT w.AuthorId, w.PublicationId, sum(w.n * h.n) AS d FROM w JOIN h ON h.AuthorId = w.AuthorId AND h.PublicationId = w.PublicationId AND h.j = w.j GROUP BY 1, 2)
SELECT s.AuthorId, s.PublicationId, round(CASE WHEN qb.q IS NOT NULL AND qa.q IS NOT NULL THEN coalesce(d, 0) / sqrt(qa.q * qb.q) END, 6) AS PivotScore FROM sq s LEFT JOIN qb ON qb.AuthorId = s.AuthorId AND qb.PublicationId = s.PublicationId LEFT JOIN qa ON qa.a = s.PublicationId LEFT JOIN dt ON dt.AuthorId = s.AuthorId AND dt.PublicationId = s.PublicationId"""


def _pivot(spark, d, **options):
    author = table(spark, d, "lineitem").select(F.col("l_partkey").alias("AuthorId"), F.col("l_orderkey").alias("PublicationId")).distinct()
    journal = M.pub(spark, d).select(F.col("PublicationId").alias("CitedPublicationId"), F.col("JournalId").alias("CitedJournalId"))
    refs = M.pub2ref(spark, d).join(journal, "CitedPublicationId")
    return rounded(C.pivot_score(author.join(M.pub(spark, d).select("PublicationId", "Year"), "PublicationId"), refs, **options), "PivotScore")


@query(PIVOT.format(""))
def pivot_score(spark, d):
    return _pivot(spark, d)


@query(PIVOT.format("AND w.i >= s.i - 3"))
def pivot_score_previous(spark, d):
    return _pivot(spark, d, previous=3)


# Text


@query(""", w AS (SELECT PublicationId, t, unnest(regexp_extract_all(t, '([a-z0-9_]{2,})')) AS w FROM (SELECT p_partkey AS PublicationId, lower(concat(p_name, ' ', p_type, ' ', p_brand)) AS t FROM part)), c AS (SELECT PublicationId, w, count(*) AS c FROM w GROUP BY 1, 2)
SELECT x.w AS src, y.w AS dst, CAST(sum(x.c * y.c) AS BIGINT) AS weight FROM c x JOIN c y ON x.PublicationId = y.PublicationId AND x.w <= y.w GROUP BY 1, 2""")
def coword_network(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("PublicationId"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("Title"))
    return T.coword_network(p, stop_words=())


@query("SELECT x.o_orderkey AS PublicationId, min(y.o_orderkey) AS match FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderpriority = y.o_orderpriority AND x.o_orderkey <> y.o_orderkey GROUP BY 1")
def align_publications_exact(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("PublicationId"), "o_custkey", "o_orderpriority")
    return T.align_publications(o, exact=["o_custkey", "o_orderpriority"], approximate=None)


@query()
def align_publications_fuzzy(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("PublicationId"), "c_nationkey", "c_mktsegment", F.col("c_name").alias("Title"))
    return rounded(T.align_publications(c, exact=["c_nationkey", "c_mktsegment"]), "Cosine", "Ratio")


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(source), '[0-9]+'), '') AS num, trim(regexp_replace(lower(lang), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) AS doi FROM documents")
def standardize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all(F.lower("source"), F.lit("([0-9]+)"), F.lit(1)), "").alias("num"), X.standard_doi(F.col("lang")).alias("doi"))


@query()
def clean_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.clean_person_name(F.col("c_name")).alias("person"), X.clean_institution_name(F.col("c_mktsegment")).alias("institution"))


@query(""", v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT label, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM v), m AS (SELECT i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 2) AS x FROM u GROUP BY 1), ax AS (SELECT list(x ORDER BY i) AS x FROM m)
SELECT vec_id, round(list_inner_product(v.x, ax.x) / sqrt(list_inner_product(v.x, v.x) * list_inner_product(ax.x, ax.x)), 6) AS SemAxis FROM v, ax""")
def sem_axis(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(arrays.sem_axis(e, e.where("label = 1"), e.where("label = 2"), "vec_id", "embedding"), "SemAxis")


@query(""", t AS (SELECT o_custkey % 5 AS g, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS p FROM t), z AS (SELECT x.g, x.k, x.p AS p, y.p AS q FROM p x JOIN p y ON x.k = y.k AND y.g = 0)
SELECT g, round(sum(p * log2(p / q)), 6) + 0.0 AS Kl, round(0.5 * (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))), 6) + 0.0 AS Js FROM z GROUP BY 1""")
def divergence(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("g"), F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    p = t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("g"))).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("p"))
    both = p.crossJoin(F.broadcast(p.where("g = 0").select(F.col("p").alias("q"))))
    return rounded(both.select("g", arrays.kl(F.col("p"), F.col("q")).alias("Kl"), arrays.jensen_shannon(F.col("p"), F.col("q")).alias("Js")), "Kl", "Js").withColumns({"Kl": F.col("Kl") + 0.0, "Js": F.col("Js") + 0.0})


@query(""", t AS (SELECT o_custkey % 5 AS g, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), z AS (SELECT x.g, x.n AS a, y.n AS b FROM t x LEFT JOIN t y ON y.k = x.k AND y.g = (x.g + 1) % 5)
SELECT g, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS Cosine FROM z GROUP BY 1""")
def sparse_cosine(spark, d):
    t = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("g"), F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return rounded(arrays.sparse_cosine(t, t.withColumn("g", (F.col("g") + 4) % 5), ["g"], "k", "n"), "Cosine")


# Filters and scans


@query("SELECT PublicationId FROM pub WHERE Year BETWEEN 1996 AND 1998 AND DocType IN ('F', 'P') AND PublicationId IN (SELECT PublicationId FROM p2f WHERE FieldId IN ('Brand#11', 'Brand#12', 'Brand#1'))")
def global_filters(spark, d):
    return filters.publication_ids([filters.YearFilter(1996, 1998), filters.DocTypeFilter(["F", "P"]), filters.FieldFilter(["Brand#11", "Brand#12", "Brand#1"])], M.pub(spark, d), M.pub2field(spark, d))


@query("SELECT a AS CitingPublicationId, b AS CitedPublicationId FROM e WHERE a IN (SELECT PublicationId FROM pub WHERE Year <= 1997) AND b IN (SELECT PublicationId FROM pub WHERE Year <= 1997)")
def filtered_references(spark, d):
    return filters.filter_references(M.pub2ref(spark, d), filters.publication_ids(filters.YearFilter(None, 1997), M.pub(spark, d)))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedup_keep_last(spark, d):
    from scholarmill.catalog import dedup

    return dedup(table(spark, d, "orders"), ["o_custkey"], "last", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


# Fits, without SQL


@query()
def career_hotstreak(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("AuthorId"), F.col("event_id").alias("PublicationId"), F.col("ts").alias("Date"), F.col("value").alias("C10"))
    return rounded(careers.hot_streak(e), "Baseline", "StreakGamma")


@query()
def productivity_trajectory(spark, d):
    return rounded(careers.productivity_trajectory(A.yearly_productivity(author_years(spark, d))), "t_break", "b", "m1", "m2")


@query()
def longterm_impact(spark, d):
    return rounded(careers.longterm_impact(M.dated_refs(spark, d)), "lam", "mu", "sig")


@query()
def career_topics(spark, d):
    return careers.career_topics(author_years(spark, d).where(F.col("AuthorId").isNotNull()), M.pub2ref(spark, d))


@query()
def node2vec_walks(spark, d):
    return embedding.random_walks(_trade(spark, d), p=0.5, q=2.0).withColumn("path", F.array_join("path", ","))
