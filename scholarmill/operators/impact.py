"""Citation impact: totals, horizons, self-citations, yearly counts and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholarmill.operators.ranking import year_normalised


def self_citations(pub2ref: DataFrame, author2pub: DataFrame) -> DataFrame:
    """References (distinct) whose ends share an author."""
    a = author2pub.select("AuthorId", "PublicationId").dropna().distinct()
    citing = a.select("AuthorId", F.col("PublicationId").alias("CitingPublicationId"))
    cited = a.select(F.col("AuthorId").alias("_author"), F.col("PublicationId").alias("CitedPublicationId"))
    edges = pub2ref.select("CitingPublicationId", "CitedPublicationId").distinct()
    both = edges.join(citing, "CitingPublicationId").join(cited, "CitedPublicationId")
    return both.where("AuthorId = _author").select("CitingPublicationId", "CitedPublicationId").distinct()


def remove_selfcitations(pub2ref: DataFrame, author2pub: DataFrame) -> DataFrame:
    """pub2ref without references whose ends share an author; those without authors stay."""
    return pub2ref.join(self_citations(pub2ref, author2pub), ["CitingPublicationId", "CitedPublicationId"], "left_anti")


def dated(pub2ref: DataFrame, pub: DataFrame) -> DataFrame:
    """Distinct references with CitingYear and CitedYear, 0 where there is none."""
    year = pub.select("PublicationId", "Year").where("PublicationId IS NOT NULL").groupBy("PublicationId").agg(F.max("Year").alias("Year"))
    citing = year.select(F.col("PublicationId").alias("CitingPublicationId"), F.col("Year").alias("CitingYear"))
    cited = year.select(F.col("PublicationId").alias("CitedPublicationId"), F.col("Year").alias("CitedYear"))
    edges = pub2ref.select("CitingPublicationId", "CitedPublicationId").dropna().distinct()
    return edges.join(citing, "CitingPublicationId", "left").join(cited, "CitedPublicationId", "left").fillna(0, ["CitingYear", "CitedYear"])


def compute_impact(pub2ref: DataFrame, pub: DataFrame, author2pub: DataFrame | None = None, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(PublicationId, Year, Ctotal, C<k>...) and with author2pub the same without self-citations, as *_noself.

    Citations from before the cited year don't count; a missing year is 0, so
    such a publication has all of its citations in Ctotal. Only publications
    with a citation that counts have a row. One aggregation for all columns.
    """
    edges = dated(pub2ref, pub).where("CitingYear >= CitedYear")
    kept = F.lit(True)
    if author2pub is not None:
        own = self_citations(pub2ref, author2pub).withColumn("_self", F.lit(True))
        edges = edges.join(own, ["CitingPublicationId", "CitedPublicationId"], "left")
        kept = F.col("_self").isNull()
    within = {"Ctotal": F.lit(True)} | {f"C{k}": F.col("CitingYear") <= F.col("CitedYear") + k for k in horizons}
    aggs = [F.count_if(c).alias(n) for n, c in within.items()]
    if author2pub is not None:
        aggs += [F.count_if(c & kept).alias(f"{n}_noself") for n, c in within.items()]
    return edges.groupBy(F.col("CitedPublicationId").alias("PublicationId")).agg(F.max("CitedYear").alias("Year"), *aggs)


def load_impact(impact: DataFrame, year_normed: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """impact with <column>_norm, by the mean of the year over all rows, and only then those of ids."""
    if year_normed:
        impact = year_normalised(impact, [c for c in impact.columns if c not in ("PublicationId", "Year")])
    return impact if ids is None else impact.join(ids.select("PublicationId").distinct(), "PublicationId", "left_semi")


def yearly_citations(pub2ref: DataFrame, pub: DataFrame) -> DataFrame:
    """(PublicationId, CitingYear, YearlyCitations, CitedYear); citations from before the cited year don't count."""
    edges = dated(pub2ref, pub).where("CitingYear >= CitedYear")
    return edges.groupBy(F.col("CitedPublicationId").alias("PublicationId"), "CitingYear").agg(F.count("*").alias("YearlyCitations"), F.max("CitedYear").alias("CitedYear"))
