"""Networks as edge lists (src, dst, weight), undirected ones with src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scholarmill.operators.components import connected_components
from scholarmill.operators.filters import in_ids
from scholarmill.schema import MetricError
from scholarmill.session import spread


def bipartite(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """(row, column, weight): weights of repeated pairs added up, 1 each without a weight column."""
    return df.dropna(subset=[row, column]).groupBy(row, column).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("weight"))


def project(df: DataFrame, node: str, through: str, weight: str | None = None, by: list[str] | None = None, max_degree: int | None = None) -> DataFrame:
    """Nodes that share a `through`: the sum of products of their weights, 1 each without a weight column.

    by adds columns, as a year, that both sides share. A through of degree n
    makes n (n - 1) / 2 pairs; max_degree, if given, leaves out larger ones.
    """
    by = by or []
    rows = spread(df.dropna(subset=[node, through, *by]), through, *by)
    rows = rows.select(node, through, *by).distinct().withColumn("_w", F.lit(1)) if weight is None else rows.groupBy(node, through, *by).agg(F.sum(weight).alias("_w"))
    if max_degree is not None:
        few = rows.groupBy(through, *by).agg(F.count("*").alias("_n")).where(F.col("_n") <= max_degree).drop("_n")
        rows = rows.join(few, [through, *by], "left_semi")
    a = rows.select(through, *by, F.col(node).alias("src"), F.col("_w").alias("_a"))
    b = rows.select(through, *by, F.col(node).alias("dst"), F.col("_w").alias("_b"))
    pairs = a.join(b, [through, *by]).where("src < dst").select("src", "dst", *by, (F.col("_a") * F.col("_b")).alias("_p"))
    return spread(pairs, "src", "dst", *by).groupBy("src", "dst", *by).agg(F.sum("_p").alias("weight"))


def coauthorship(paa: DataFrame, focus: DataFrame | None = None, constraint: str = "authors", year: str | None = None, max_degree: int | None = None) -> DataFrame:
    """Links of authors by their common publications.

    With focus, its first column author ids: "authors" has the links among
    these, "publications" all links on their publications, "ego" all links of
    the authors of these publications.
    """
    rows = paa.select("AuthorId", "PublicationId", *([year] if year else [])).dropna()
    if focus is not None:
        if constraint not in ("authors", "publications", "ego"):
            raise MetricError(constraint)
        mine = in_ids(rows, "AuthorId", focus)
        if constraint == "authors":
            rows = mine
        else:
            rows_on = in_ids(rows, "PublicationId", mine, "PublicationId")
            rows = rows_on if constraint == "publications" else in_ids(rows, "AuthorId", rows_on, "AuthorId")
    return project(rows, "AuthorId", "PublicationId", by=[year] if year else None, max_degree=max_degree)


def cocitation(pub2ref: DataFrame, focus: DataFrame | None = None, constraint: str = "citing", year: str | None = None, max_degree: int | None = None) -> DataFrame:
    """Links of cited publications by those that cite both; focus ids limit the citing ones, the cited ones, or with "egocited" the citing ones to those that cite them."""
    edges = pub2ref.select("CitingPublicationId", "CitedPublicationId", *([year] if year else [])).dropna()
    if focus is not None:
        if constraint == "citing":
            edges = in_ids(edges, "CitingPublicationId", focus)
        elif constraint == "cited":
            edges = in_ids(edges, "CitedPublicationId", focus)
        elif constraint == "egocited":
            edges = in_ids(edges, "CitingPublicationId", in_ids(edges, "CitedPublicationId", focus), "CitingPublicationId")
        else:
            raise MetricError(constraint)
    return project(edges, "CitedPublicationId", "CitingPublicationId", by=[year] if year else None, max_degree=max_degree)


def coupling(pub2ref: DataFrame, focus: DataFrame | None = None, constraint: str = "citing", max_degree: int | None = None) -> DataFrame:
    """Links of citing publications by their common references."""
    edges = pub2ref.select("CitingPublicationId", "CitedPublicationId").dropna()
    if focus is not None:
        if constraint not in ("citing", "cited"):
            raise MetricError(constraint)
        edges = in_ids(edges, "CitingPublicationId" if constraint == "citing" else "CitedPublicationId", focus)
    return project(edges, "CitingPublicationId", "CitedPublicationId", max_degree=max_degree)


def temporal_cocitation(dated_refs: DataFrame) -> DataFrame:
    """(CitingYear, PublicationId, Neighbours, Citations): how many publications are cited together with one in a year, and how often it is cited."""
    pairs = cocitation(dated_refs, year="CitingYear")
    both = pairs.select("CitingYear", F.explode(F.array("src", "dst")).alias("PublicationId"))
    near = both.groupBy("CitingYear", "PublicationId").agg(F.count("*").alias("Neighbours"))
    cites = spread(dated_refs.select("CitingYear", "CitingPublicationId", F.col("CitedPublicationId").alias("PublicationId")).dropna(), "PublicationId", "CitingYear").distinct().groupBy("CitingYear", "PublicationId").agg(F.count("*").alias("Citations"))
    return cites.join(near, ["CitingYear", "PublicationId"], "left").fillna(0, ["Neighbours"])


def citation_edges(pub2ref: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) references, of which both ends are in the subset."""
    edges = pub2ref.select(F.col("CitingPublicationId").alias("src"), F.col("CitedPublicationId").alias("dst")).dropna().distinct()
    return edges if subset is None else in_ids(in_ids(edges, "src", subset), "dst", subset)


def directed(edges: DataFrame) -> DataFrame:
    """Each undirected edge both ways."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))), *rest)


def threshold(edges: DataFrame, least: float = 0) -> DataFrame:
    """Edges of weight above the threshold."""
    return edges.where(F.col("weight") > least)


def backbone(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Directed edges that the disparity filter keeps: (1 - weight / strength) ** (degree - 1) < alpha. A node's only edge goes."""
    w = Window.partitionBy("src")
    rows = spread(edges.where("weight > 0"), "src").withColumn("_p", F.col("weight") / F.sum("weight").over(w)).withColumn("_k", F.count("*").over(w))
    return rows.where((F.col("_p") < 1) & (F.pow(1 - F.col("_p"), F.col("_k") - 1) < alpha)).drop("_p", "_k")


def trajectory(paa: DataFrame, time: str = "Year", affiliation: str = "AffiliationId", person: str = "AuthorId", tie: str = "PublicationId") -> DataFrame:
    """Moves (person, time, affiliation, next_<affiliation>): a person's affiliations in time without repeats in a row, each with the next."""
    w = Window.partitionBy(person).orderBy(time, tie, affiliation)
    rows = paa.dropna(subset=[person, time, affiliation]).withColumn("_before", F.lag(affiliation).over(w))
    rows = rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(affiliation)))
    return rows.withColumn(f"next_{affiliation}", F.lead(affiliation).over(w)).select(person, time, affiliation, f"next_{affiliation}").dropna()


def mobility(moves: DataFrame, affiliation: str = "AffiliationId") -> DataFrame:
    """The network of moves."""
    return moves.groupBy(F.col(affiliation).alias("src"), F.col(f"next_{affiliation}").alias("dst")).agg(F.count("*").alias("weight"))


def largest_component(edges: DataFrame) -> DataFrame:
    """(vertex) of the largest connected component; of equal ones, that with the least vertex."""
    member = connected_components(edges)
    size = member.groupBy("component").agg(F.count("*").alias("n"))
    best = size.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return member.join(F.broadcast(best), "component", "left_semi").select("vertex")


def schubert_glanzel(edges: DataFrame) -> DataFrame:
    """Directed edges with Normalised: an edge's share of its row, by the column's share of what isn't in the row."""
    total = edges.agg(F.sum("weight").alias("_all"))
    row, col = F.sum("weight").over(Window.partitionBy("src")), F.sum("weight").over(Window.partitionBy("dst"))
    rows = edges.withColumn("_row", row).withColumn("_col", col).crossJoin(F.broadcast(total))
    return rows.withColumn("Normalised", F.try_divide(F.col("weight") / F.col("_row"), F.try_divide(F.col("_col"), F.col("_all") - F.col("_row")))).drop("_row", "_col", "_all")


def block_density(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src_community, dst_community, Density): weight between communities by the product of their sizes; member is (vertex, community)."""
    size = member.groupBy("community").agg(F.count("*").alias("n"))
    a = member.select(F.col("vertex").alias("src"), F.col("community").alias("src_community"))
    b = member.select(F.col("vertex").alias("dst"), F.col("community").alias("dst_community"))
    total = edges.join(a, "src").join(b, "dst").groupBy("src_community", "dst_community").agg(F.sum("weight").alias("_w"))
    total = total.join(size.toDF("src_community", "_m"), "src_community").join(size.toDF("dst_community", "_n"), "dst_community")
    return total.select("src_community", "dst_community", (F.col("_w") / (F.col("_m") * F.col("_n"))).alias("Density"))


def estimate_resolution(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row (omega_in, omega_out, gamma): the resolution of modularity at which it is the likelihood of a planted partition with these rates."""
    both = directed(edges)
    degree = both.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k")).join(member, "vertex")
    kappa = degree.groupBy("community").agg(F.sum("k").alias("kc")).agg(F.sum("kc").alias("two_m"), F.sum(F.col("kc") * F.col("kc")).alias("kc2"))
    a, b = member.select(F.col("vertex").alias("src"), F.col("community").alias("ca")), member.select(F.col("vertex").alias("dst"), F.col("community").alias("cb"))
    inside = both.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0)).alias("twice_in"))
    x = kappa.crossJoin(inside)
    x = x.withColumn("omega_in", F.try_divide(F.col("twice_in"), F.col("kc2") / F.col("two_m"))).withColumn("omega_out", F.try_divide(F.col("two_m") - F.col("twice_in"), F.col("two_m") - F.col("kc2") / F.col("two_m")))
    gamma = F.when((F.col("omega_in") > 0) & (F.col("omega_out") > 0), F.try_divide(F.col("omega_in") - F.col("omega_out"), F.ln("omega_in") - F.ln("omega_out")))
    return x.select("omega_in", "omega_out", gamma.alias("gamma"))
