"""Fields of science: diversity of references, citation between fields, and their distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarmill.schema import MetricError
from scholarmill.session import cut_lineage, spread

#: Pairs of fields whose distances are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 200_000


def _sides(direction: str) -> tuple[str, str]:
    """(column of the publication that is looked at, column of its references or citers)."""
    if direction == "references":
        return "CitingPublicationId", "CitedPublicationId"
    if direction == "citations":
        return "CitedPublicationId", "CitingPublicationId"
    raise MetricError(direction)


def _fields_of(edges: DataFrame, contributions: DataFrame) -> DataFrame:
    """(PublicationId, FieldId, _w): the fields of each _t of edges (PublicationId, _t), parted by PublicationId; they travel as lists, one row an edge."""
    lists = contributions.groupBy(F.col("PublicationId").alias("_t")).agg(F.collect_list(F.struct("FieldId", "_w")).alias("_l"))
    return spread(edges.join(lists, "_t").select("PublicationId", "_l"), "PublicationId").select("PublicationId", F.inline("_l"))


def _field_counts(pub2ref: DataFrame, pub2field: DataFrame, direction: str, focus: DataFrame | None) -> DataFrame:
    source, target = _sides(direction)
    edges = pub2ref.select(F.col(source).alias("PublicationId"), F.col(target).alias("_t")).dropna().distinct()
    if focus is not None:
        edges = edges.join(focus.select("PublicationId").distinct(), "PublicationId", "left_semi")
    return _fields_of(edges, _contributions(pub2field, False)).groupBy("PublicationId", "FieldId").agg(F.count("*").alias("_n")).groupBy("PublicationId")


def simpson_interdisciplinarity(pub2ref: DataFrame, pub2field: DataFrame, direction: str = "references", finite: bool = False, focus: DataFrame | None = None) -> DataFrame:
    """(PublicationId, SimpsonInterdisciplinarity): 1 less the sum of squared shares of the fields of its references or citers; finite: without replacement, null for one field entry."""
    n = F.sum("_n")
    value = F.try_divide(F.sum(F.col("_n") * (F.col("_n") - 1)), n * (n - 1)) if finite else F.sum(F.col("_n") * F.col("_n")) / (n * n)
    return _field_counts(pub2ref, pub2field, direction, focus).agg((1 - value).alias("SimpsonInterdisciplinarity"))


def shannon_interdisciplinarity(pub2ref: DataFrame, pub2field: DataFrame, direction: str = "references", normalised: bool = False, focus: DataFrame | None = None) -> DataFrame:
    """(PublicationId, ShannonInterdisciplinarity): entropy of these fields, normalised by that of all fields alike."""
    n = F.sum("_n")
    out = _field_counts(pub2ref, pub2field, direction, focus).agg((F.ln(n) - F.sum(F.col("_n") * F.ln("_n")) / n).alias("ShannonInterdisciplinarity"))
    if not normalised:
        return out
    k = pub2field.agg(F.countDistinct("FieldId").alias("_k"))
    return out.crossJoin(F.broadcast(k)).withColumn("ShannonInterdisciplinarity", F.try_divide("ShannonInterdisciplinarity", F.ln("_k"))).drop("_k")


def _contributions(pub2field: DataFrame, normed: bool) -> DataFrame:
    """(PublicationId, FieldId, _w): each field's part in a publication, 1 or 1 / its fields."""
    rows = pub2field.select("PublicationId", "FieldId").dropna().distinct()
    if not normed:
        return rows.withColumn("_w", F.lit(1.0))
    return rows.join(rows.groupBy("PublicationId").agg(F.count("*").alias("_k")), "PublicationId").select("PublicationId", "FieldId", (1 / F.col("_k")).alias("_w"))


def field_citation_vectors(pub2ref: DataFrame, pub2field: DataFrame, normed: bool = True, direction: str = "references", year: str | None = None, normalise: str | None = None) -> DataFrame:
    """(SourceFieldId, TargetFieldId, [year], Weight): contributions multiplied over references; normalise "source" or "target" makes each one's weights add up to 1."""
    source, target = _sides(direction)
    years = [year] if year else []
    edges = pub2ref.select(F.col(source).alias("_s"), F.col(target).alias("_t"), *years).dropna().distinct()
    c = _contributions(pub2field, normed)
    a = c.groupBy(F.col("PublicationId").alias("_s")).agg(F.collect_list(F.struct(F.col("FieldId").alias("SourceFieldId"), F.col("_w").alias("_a"))).alias("_la"))
    b = c.groupBy(F.col("PublicationId").alias("_t")).agg(F.collect_list(F.struct(F.col("FieldId").alias("TargetFieldId"), F.col("_w").alias("_b"))).alias("_lb"))
    # Lists of fields travel with the edges and are opened last, so that rows don't multiply before the sums.
    both = edges.join(b, "_t").join(a, "_s").select("_la", *years, F.inline("_lb")).select("TargetFieldId", "_b", *years, F.inline("_la"))
    out = both.groupBy("SourceFieldId", "TargetFieldId", *years).agg(F.sum(F.col("_a") * F.col("_b")).alias("Weight"))
    if normalise is None:
        return out
    side = {"source": "SourceFieldId", "target": "TargetFieldId"}[normalise]
    return out.withColumn("Weight", F.col("Weight") / F.sum("Weight").over(Window.partitionBy(side, *years)))


def field_citation_share(pub2ref: DataFrame, pub2field: DataFrame, normed: bool = True, direction: str = "references", year: str | None = None, upper_only: bool = False) -> DataFrame:
    """(SourceFieldId, TargetFieldId, [year], Share): the target's share of the source's references or citations; upper_only keeps source < target."""
    out = field_citation_vectors(pub2ref, pub2field, normed, direction, year, "source").withColumnRenamed("Weight", "Share")
    return out.where("SourceFieldId < TargetFieldId") if upper_only else out


def field_citation_strength(pub2ref: DataFrame, pub2field: DataFrame, pub: DataFrame, normed: bool = True, direction: str = "references", baseline_year: int = 1950, year: str | None = None) -> DataFrame:
    """(SourceFieldId, TargetFieldId, [year], Strength): the share, by the field's share of publications since baseline_year, up to the year if by year.

    The field is the target for references, the source for citations. Null without such publications.
    """
    share = field_citation_share(pub2ref, pub2field, normed, direction, year)
    rows = pub2field.select("PublicationId", "FieldId").dropna().distinct().join(pub.select("PublicationId", "Year"), "PublicationId").where(F.col("Year") >= baseline_year)
    key = "TargetFieldId" if direction == "references" else "SourceFieldId"
    if year is None:
        size = rows.groupBy("FieldId").agg(F.count("*").alias("_n"))
        base = size.crossJoin(F.broadcast(size.agg(F.sum("_n").alias("_all")))).select(F.col("FieldId").alias(key), (F.col("_n") / F.col("_all")).alias("_base"))
        return share.join(base, key, "left").select("SourceFieldId", "TargetFieldId", F.try_divide("Share", "_base").alias("Strength"))
    # Publications so far, by field and over all, at each year of the shares.
    years = share.select(F.col(year).alias("_y")).distinct()
    per = rows.groupBy("FieldId", "Year").agg(F.count("*").alias("_n"))
    upto = per.join(F.broadcast(years), F.col("Year") <= F.col("_y")).groupBy("FieldId", "_y").agg(F.sum("_n").alias("_n"))
    upto = upto.withColumn("_all", F.sum("_n").over(Window.partitionBy("_y")))
    base = upto.select(F.col("FieldId").alias(key), F.col("_y").alias(year), (F.col("_n") / F.col("_all")).alias("_base"))
    return share.join(base, [key, year], "left").select("SourceFieldId", "TargetFieldId", year, F.try_divide("Share", "_base").alias("Strength"))


def field_citation_distance(pub2ref: DataFrame, pub2field: DataFrame, normed: bool = True, direction: str = "references", year: str | None = None, metric: str = "cosine") -> DataFrame:
    """(iFieldId, jFieldId, [year], FieldDistance) for i < j, where it isn't 0; metric is cosine, euclidean or cityblock.

    A field without citations in a year is at cosine distance 1 from all.
    """
    years = [year] if year else []
    v = field_citation_vectors(pub2ref, pub2field, normed, direction, year)
    fields = pub2field.select("FieldId").dropna().distinct()
    pairs = fields.toDF("iFieldId").join(fields.toDF("jFieldId"), F.col("iFieldId") < F.col("jFieldId"))
    if year:
        pairs = pairs.crossJoin(F.broadcast(v.select(year).distinct()))
    i = v.select(F.col("SourceFieldId").alias("iFieldId"), "TargetFieldId", *years, F.col("Weight").alias("_a"))
    j = v.select(F.col("SourceFieldId").alias("jFieldId"), "TargetFieldId", *years, F.col("Weight").alias("_b"))
    sizes = v.groupBy("SourceFieldId", *years).agg(F.sum(F.col("Weight") * F.col("Weight")).alias("_q"), F.sum("Weight").alias("_s"))
    both = i.join(j, ["TargetFieldId", *years]).where("iFieldId < jFieldId").groupBy("iFieldId", "jFieldId", *years).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"), F.sum(F.least("_a", "_b")).alias("_min"))
    out = pairs.join(both, ["iFieldId", "jFieldId", *years], "left")
    for side in "ij":
        out = out.join(sizes.toDF(f"{side}FieldId", *years, f"_q{side}", f"_s{side}"), [f"{side}FieldId", *years], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    distance: dict[str, Column] = {
        "cosine": 1 - zero(F.try_divide(F.col("_dot"), F.sqrt(F.col("_qi") * F.col("_qj")))),
        "euclidean": F.sqrt(F.greatest(F.lit(0.0), zero(F.col("_qi")) + zero(F.col("_qj")) - 2 * zero(F.col("_dot")))),
        "cityblock": zero(F.col("_si")) + zero(F.col("_sj")) - 2 * zero(F.col("_min")),
    }
    if metric not in distance:
        raise MetricError(metric)
    return out.select("iFieldId", "jFieldId", *years, distance[metric].alias("FieldDistance")).where(F.abs("FieldDistance") > 1e-12)


def raostirling(pub2ref: DataFrame, pub2field: DataFrame, normed: bool = True, direction: str = "references", focus: DataFrame | None = None, distance: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """(PublicationId, RaoStirling): shares of the fields of its references or citers, multiplied over pairs with their distances; 0 for one field."""
    source, target = _sides(direction)
    if distance is None:
        distance = field_citation_distance(pub2ref, pub2field, normed, direction, metric=metric)
    edges = pub2ref.select(F.col(source).alias("PublicationId"), F.col(target).alias("_t")).dropna().distinct()
    if focus is not None:
        edges = edges.join(focus.select("PublicationId").distinct(), "PublicationId", "left_semi")
    share = _fields_of(edges, _contributions(pub2field, normed)).groupBy("PublicationId", "FieldId").agg(F.sum("_w").alias("_w"))
    # A publication's pairs of fields are made from its list, and added up where they are made.
    lists = share.groupBy("PublicationId").agg(F.array_sort(F.collect_list(F.struct("FieldId", "_w"))).alias("_l"), F.sum("_w").alias("_s"))
    pairs = lists.select("PublicationId", "_s", "_l", F.posexplode("_l").alias("_k", "_x"))
    pairs = pairs.select("PublicationId", "_s", "_x", F.explode(F.slice("_l", F.col("_k") + 2, F.size("_l"))).alias("_y"))
    pairs = pairs.select("PublicationId", F.col("_x.FieldId").alias("iFieldId"), F.col("_y.FieldId").alias("jFieldId"), (F.col("_x._w") / F.col("_s") * (F.col("_y._w") / F.col("_s"))).alias("_p"))
    distance = cut_lineage(distance.select("iFieldId", "jFieldId", "FieldDistance"))
    near = F.broadcast(distance) if distance.count() <= BROADCAST_PAIRS else distance
    value = pairs.join(near, ["iFieldId", "jFieldId"]).groupBy("PublicationId").agg(F.sum(F.col("_p") * F.col("FieldDistance")).alias("RaoStirling"))
    return lists.select("PublicationId").join(value, "PublicationId", "left").fillna(0.0, ["RaoStirling"])
