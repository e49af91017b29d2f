"""Ranks, rank statistics and windows over ordered rows. Ties are broken by a given column, so results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarmill.schema import MetricError


def rank(df: DataFrame, column: str, by: str | list[str], tie: str, ascending: bool = True, normed: bool = False, name: str | None = None) -> DataFrame:
    """df with <column>Rank: from 0 in each group; normed by the group's size less 1, null in a group of one."""
    by = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.asc(column) if ascending else F.desc(column), F.asc(tie))) - 1
    if normed:
        r = r / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return df.withColumn(name or f"{column}Rank", r)


def citation_rank(pub: DataFrame, by: str = "Year", column: str = "C10", ascending: bool = True, normed: bool = False) -> DataFrame:
    return rank(pub, column, by, "PublicationId", ascending, normed)


def hit_papers(pub: DataFrame, by: str = "Year", column: str = "C10", least: float = 0.95) -> DataFrame:
    """pub with Hit: whether the normed rank in the group is `least` or more."""
    return rank(pub, column, by, "PublicationId", True, True, "_rank").withColumn("Hit", F.coalesce(F.col("_rank") >= least, F.lit(False))).drop("_rank")


def field_rank(impact: DataFrame, pub2field: DataFrame, columns: list[str]) -> DataFrame:
    """(PublicationId, FieldId, Year, <column>Rank): normed ranks of citations within field and year."""
    out = pub2field.select("PublicationId", "FieldId").distinct().join(impact.select("PublicationId", "Year", *columns), "PublicationId")
    for c in columns:
        out = rank(out, c, ["Year", "FieldId"], "PublicationId", True, True)
    return out.drop(*columns)


def year_normalised(df: DataFrame, columns: list[str], by: str = "Year") -> DataFrame:
    """df with <column>_norm: each value by the mean of its year; null where that is 0."""
    w = Window.partitionBy(by)
    return df.withColumns({f"{c}_norm": F.try_divide(F.col(c), F.avg(c).over(w)) for c in columns})


def midrank(column: str, by: list[str]) -> Column:
    """Ranks from 1 with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2


def auc(df: DataFrame, by: str, column: str, positive: str) -> DataFrame:
    """(by, AUC): the chance that a value of a positive row is above that of another, ties half; null if one side is empty."""
    rows = df.dropna(subset=[by, column, positive]).select(by, column, F.col(positive).cast("boolean").alias("_x")).withColumn("_r", midrank(column, [by]))
    m, n = F.count_if(F.col("_x")), F.count_if(~F.col("_x"))
    return rows.groupBy(by).agg(F.try_divide(F.sum(F.when(F.col("_x"), F.col("_r"))) - m * (m + 1) / 2, m * n).alias("AUC"))


def delong(df: DataFrame, by: str, column: str, positive: str) -> DataFrame:
    """(by, AUC, Variance, Z): AUC with DeLong's variance, and its distance from 1/2 in standard deviations; null with fewer than two on a side."""
    rows = df.dropna(subset=[by, column, positive]).select(by, column, F.col(positive).cast("boolean").alias("_x"))
    rows = rows.withColumn("_all", midrank(column, [by])).withColumn("_own", midrank(column, [by, "_x"]))
    w = Window.partitionBy(by)
    m, n = F.count_if(F.col("_x")).over(w), F.count_if(~F.col("_x")).over(w)
    other = F.when(F.col("_x"), F.try_divide(F.col("_all") - F.col("_own"), n)).otherwise(1 - F.try_divide(F.col("_all") - F.col("_own"), m))
    v = rows.withColumn("_v", other)
    pos, neg = F.when(F.col("_x"), F.col("_v")), F.when(~F.col("_x"), F.col("_v"))
    out = v.groupBy(by).agg(F.avg(pos).alias("AUC"), (F.try_divide(F.var_samp(pos), F.count(pos)) + F.try_divide(F.var_samp(neg), F.count(neg))).alias("Variance"))
    return out.withColumn("AUC", F.when(F.col("Variance").isNotNull(), F.col("AUC"))).withColumn("Z", F.try_divide(F.col("AUC") - 0.5, F.sqrt("Variance")))


def holm(df: DataFrame, p: str, by: list[str], tie: str, alpha: float = 0.05) -> DataFrame:
    """df with Reject: Holm's step-down test within each group; nulls aren't tests and have a null."""
    w = Window.partitionBy(*by, F.col(p).isNull())
    o = w.orderBy(p, tie)
    rows = df.withColumn("_r", F.row_number().over(o)).withColumn("_k", F.count("*").over(w))
    rows = rows.withColumn("_stop", F.min(F.when(F.col(p) > alpha / (F.col("_k") - F.col("_r") + 1), F.col("_r"))).over(w))
    return rows.withColumn("Reject", F.when(F.col(p).isNotNull(), F.col("_r") < F.coalesce("_stop", F.col("_k") + 1))).drop("_r", "_k", "_stop")


def rolling(df: DataFrame, by: str, order: str, column: str, window: int, kind: str = "past", step: int = 1) -> DataFrame:
    """df with Window: the array of a row's window, null where it isn't whole.

    "past" ends with the row, "forward" and "plain" begin with it, "centred"
    has it in the middle; plain windows leave out the rows without one, and
    the last whole one, as does the strided view they stand for. Only each
    step-th row of a group is kept.
    """
    half = (window - 1) // 2
    bounds = {"past": (-(window - 1), 0), "forward": (0, window - 1), "plain": (0, window - 1), "centred": (-half, window - 1 - half)}
    if kind not in bounds:
        raise MetricError(kind)
    w = Window.partitionBy(by).orderBy(order)
    values = F.collect_list(F.struct(column)).over(w.rowsBetween(*bounds[kind]))
    out = df.withColumn("_v", values).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    out = out.withColumn("Window", F.when(F.size("_v") == window, F.transform("_v", lambda x: x[column])))
    if kind == "plain":
        out = out.where(F.col("_i") < F.col("_n") - window)
    return out.where(F.col("_i") % step == 0).drop("_v", "_i", "_n")


def top_k(df: DataFrame, by: str, column: str, tie: str, k: int = 5) -> DataFrame:
    """The k rows of each group with the largest values."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(column), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def change_points(df: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """(by, Position): where runs of equal values begin, counted from 0, and each group's length."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, (F.row_number().over(w) - 1).alias("Position"), (~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)).alias("_new"))
    return rows.where("_new").select(by, "Position").union(df.groupBy(by).agg(F.count("*").cast("int").alias("Position")))
