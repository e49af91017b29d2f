"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholarmill.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a vertex to the least of the vertex and its neighbours."""
    e = _both_ways(edges)
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the least of these."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for each vertex of an undirected edge list; component is its least vertex.

    Alternates large-star and small-star, whose edge lists never grow, and
    writes each round to the shared folder; O(log n) rounds in practice. Self
    loops make a vertex known; edges with a null end are dropped; an empty edge
    list gives an empty result.
    """
    # Written first: it is read for loops and for links, and what makes the edges may be costly.
    edges = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    loops = edges.where("a = b").select("a").distinct()
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    shape = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        new = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")) if dict(now.dtypes)["b"] in ("bigint", "int") else F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == shape:
            break
        shape = new
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    out = stars.union(roots)
    return out.union(loops.select(F.col("a").alias("vertex"), F.col("a").alias("component")).join(out, "vertex", "left_anti"))
