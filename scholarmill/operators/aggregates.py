"""Group-by measures: counts, productivity, career spans, and indices of citation counts.

Rows with a null group are left out, as are null values; columns are named
as in the docstrings, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarmill.schema import MetricError, require_columns


def _grouped(df: DataFrame, by: str | list[str]) -> tuple[DataFrame, list[str]]:
    by = [by] if isinstance(by, str) else list(by)
    return require_columns(df, *by).dropna(subset=by), by


def groupby_count(df: DataFrame, by: str | list[str], column: str, unique: bool = True) -> DataFrame:
    """<column>Count: distinct values of a group, or its non-null ones."""
    df, by = _grouped(df, by)
    return df.groupBy(*by).agg((F.countDistinct(column) if unique else F.count(column)).alias(f"{column}Count"))


def groupby_range(df: DataFrame, by, column: str) -> DataFrame:
    """<column>Range: greatest less least."""
    df, by = _grouped(df, by)
    return df.groupBy(*by).agg((F.max(column) - F.min(column)).alias(f"{column}Range"))


def groupby_zero_col(df: DataFrame, by, column: str) -> DataFrame:
    """df with <column>FromZero: column less the least of its group."""
    df, by = _grouped(df, by)
    return df.withColumn(f"{column}FromZero", F.col(column) - F.min(column).over(Window.partitionBy(*by)))


def groupby_total(df: DataFrame, by, column: str) -> DataFrame:
    """<column>Total."""
    df, by = _grouped(df, by)
    return df.groupBy(*by).agg(F.sum(column).alias(f"{column}Total"))


def groupby_mean(df: DataFrame, by, column: str) -> DataFrame:
    """<column>Mean."""
    df, by = _grouped(df, by)
    return df.groupBy(*by).agg(F.avg(column).alias(f"{column}Mean"))


def uniquemap_by_frequency(df: DataFrame, by: str = "PublicationId", column: str = "FieldId", ascending: bool = False) -> DataFrame:
    """One (by, column) a group, whose value is the most frequent in the whole table, or the least; ties go to the lesser value."""
    rows = df.select(by, column).dropna()
    often = rows.groupBy(column).agg(F.count("*").alias("_n"))
    first = F.struct((F.col("_n") if ascending else -F.col("_n")).alias("n"), F.col(column).alias("v"))
    return rows.join(often, column).groupBy(by).agg(F.min(first)["v"].alias(column))


def productivity(df: DataFrame, by: str = "AuthorId") -> DataFrame:
    """Productivity: distinct publications of an author or a journal."""
    return groupby_count(df, by, "PublicationId").withColumnRenamed("PublicationIdCount", "Productivity")


def yearly_productivity(df: DataFrame, by: str = "AuthorId", date: str = "Year") -> DataFrame:
    """YearlyProductivity: the same by date."""
    return groupby_count(df, [by, date], "PublicationId").withColumnRenamed("PublicationIdCount", "YearlyProductivity")


def career_length(df: DataFrame, by: str = "AuthorId", date: str = "Year") -> DataFrame:
    """CareerLength: last year less first."""
    return groupby_range(df, by, date).withColumnRenamed(f"{date}Range", "CareerLength")


def start_year(df: DataFrame, by: str = "AuthorId", date: str = "Year") -> DataFrame:
    df, keys = _grouped(df, by)
    return df.groupBy(*keys).agg(F.min(date).alias("StartYear"))


def end_year(df: DataFrame, by: str = "AuthorId", date: str = "Year") -> DataFrame:
    df, keys = _grouped(df, by)
    return df.groupBy(*keys).agg(F.max(date).alias("EndYear"))


def top_field(df: DataFrame, by: str = "AuthorId", column: str = "FieldId", fractional: bool = False) -> DataFrame:
    """Top<column>: the value with most rows of a group, or with fractional the most weight, each row weighing 1 / fields of its publication; ties go to the lesser value."""
    if not fractional:
        counts = df.dropna(subset=[by, column]).groupBy(by, column).agg(F.count("*").alias("_w"))
    else:
        rows = df.dropna(subset=[by, column, "PublicationId"])
        fields = rows.groupBy("PublicationId").agg(F.countDistinct(column).alias("_k"))
        # 1/k is summed over an exact denominator, so that sums are equal where they should be.
        counts = rows.join(fields, "PublicationId").groupBy(by, column).agg(F.round(F.sum(1 / F.col("_k")), 9).alias("_w"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(column).alias("v")))["v"].alias(f"Top{column}"))


def _ranked(df: DataFrame, by: str, column: str) -> DataFrame:
    """Counts of a group in falling order with their rank from 1; equal counts are counted, not listed, so a group is one run of counts."""
    return df.dropna(subset=[by, column]).select(by, F.col(column).alias("_c")).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_c"))))


def hindex(df: DataFrame, by: str, column: str) -> DataFrame:
    """<by>Hindex: the most h so that h values are h at least."""
    counts = df.dropna(subset=[by, column]).groupBy(by, F.col(column).alias("_c")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(F.desc("_c"))
    # Of the _n items of count c, with m before them, those up to rank c count.
    upto = F.sum("_n").over(w)
    mine = F.greatest(F.lit(0), F.least(F.floor(F.col("_c")), F.col("_u")) - (F.col("_u") - F.col("_n")))
    return counts.withColumn("_u", upto).groupBy(by).agg(F.sum(mine).cast("long").alias(f"{by}Hindex"))


def gindex(df: DataFrame, by: str, column: str, mode: str = "paper") -> DataFrame:
    """<by>Gindex: the items, most cited first, whose first g have g squared citations together at least; mode "reference" asks for more than (g - 1) squared."""
    if mode not in ("paper", "reference"):
        raise MetricError(mode)
    w = Window.partitionBy(by).orderBy(F.desc("_c"), "_r").rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranked(df, by, column).withColumn("_s", F.sum("_c").over(w))
    r = F.col("_r").cast("long")
    holds = F.col("_s") >= r * r if mode == "paper" else F.col("_s") > (r - 1) * (r - 1)
    return rows.groupBy(by).agg(F.sum(holds.cast("long")).alias(f"{by}Gindex"))


def qfactor(df: DataFrame, by: str, column: str) -> DataFrame:
    """<by>Qfactor: the geometric mean of the positive values; null without any."""
    df, keys = _grouped(df, by)
    return df.groupBy(*keys).agg(F.exp(F.avg(F.when(F.col(column) > 0, F.ln(column)))).alias(f"{by}Qfactor"))


def cindex(df: DataFrame, by: str, column: str) -> DataFrame:
    """<by>Cindex: the greatest value."""
    df, keys = _grouped(df, by)
    return df.groupBy(*keys).agg(F.max(column).alias(f"{by}Cindex"))


def pindex(df: DataFrame, by: str, column: str) -> DataFrame:
    """<by>Pindex: how many values are positive."""
    df, keys = _grouped(df, by)
    return df.groupBy(*keys).agg(F.count_if(F.col(column) > 0).alias(f"{by}Pindex"))


def with_impact(df: DataFrame, impact: DataFrame, column: str) -> DataFrame:
    """df with a column of an impact table; publications that it lacks have 0."""
    return df.join(impact.select("PublicationId", column), "PublicationId", "left").fillna(0, [column])


def impact_factor(pub: DataFrame, pub2ref: DataFrame, window: int = 5, by: str = "JournalId") -> DataFrame:
    """(by, Year, ImpactFactor<window>): citations in a year to items of the `window` years before, by the number of these items.

    Our own definition, with two years the usual one. A row for each year with items in the window.
    """
    items = pub.select("PublicationId", by, "Year").dropna().distinct()
    ahead = lambda c: F.explode(F.sequence(c + 1, c + window))
    of = items.select(by, ahead(F.col("Year")).alias("Year")).groupBy(by, "Year").agg(F.count("*").alias("_items"))
    last = items.agg(F.max("Year").alias("_last"))
    citing = items.select(F.col("PublicationId").alias("CitingPublicationId"), F.col("Year").alias("_cy"))
    cited = items.select(F.col("PublicationId").alias("CitedPublicationId"), by, F.col("Year").alias("_py"))
    hits = pub2ref.select("CitingPublicationId", "CitedPublicationId").distinct().join(citing, "CitingPublicationId").join(cited, "CitedPublicationId")
    hits = hits.where((F.col("_cy") > F.col("_py")) & (F.col("_cy") <= F.col("_py") + window)).groupBy(by, F.col("_cy").alias("Year")).agg(F.count("*").alias("_hits"))
    out = of.crossJoin(F.broadcast(last)).where("Year <= _last").join(hits, [by, "Year"], "left")
    return out.select(by, "Year", (F.coalesce("_hits", F.lit(0)) / F.col("_items")).alias(f"ImpactFactor{window}"))


def team_size(paa: DataFrame) -> DataFrame:
    """TeamSize: the greatest author sequence of a publication."""
    return paa.dropna(subset=["PublicationId", "AuthorSequence"]).groupBy("PublicationId").agg(F.max("AuthorSequence").alias("TeamSize"))


def value_to_int(df: DataFrame, column: str, order: str = "value", ascending: bool = True) -> DataFrame:
    """(column, Code): distinct values numbered from 0 by value or by frequency (ties by value)."""
    values = df.select(column).dropna().groupBy(column).agg(F.count("*").alias("_n"))
    if order not in ("value", "freq"):
        raise MetricError(order)
    key = F.col(column) if order == "value" else F.col("_n")
    key = key.asc() if ascending else key.desc()
    # One task sees the distinct values only.
    return values.select(column, (F.row_number().over(Window.orderBy(key, F.col(column))) - 1).alias("Code"))


def simpson(by: str, column: str, df: DataFrame, finite: bool = False) -> DataFrame:
    """<column>Simpson: the sum of squared shares of a group's values; finite: without replacement, null for one value."""
    n = df.dropna(subset=[by, column]).groupBy(by, column).agg(F.count("*").alias("_n")).groupBy(by)
    total = F.sum("_n")
    value = F.try_divide(F.sum(F.col("_n") * (F.col("_n") - 1)), total * (total - 1)) if finite else F.sum(F.col("_n") * F.col("_n")) / (total * total)
    return n.agg(value.alias(f"{column}Simpson"))


def shannon(by: str, column: str, df: DataFrame, base: float | None = None) -> DataFrame:
    """<column>Entropy of a group's values, natural or to a base."""
    n = df.dropna(subset=[by, column]).groupBy(by, column).agg(F.count("*").alias("_n")).groupBy(by)
    total = F.sum("_n")
    value: Column = F.ln(total) - F.sum(F.col("_n") * F.ln("_n")) / total
    return n.agg((value / F.ln(F.lit(base)) if base else value).alias(f"{column}Entropy"))


def gini(df: DataFrame, by: str, column: str) -> DataFrame:
    """<column>Gini of a group's values; null if they add up to 0."""
    w = Window.partitionBy(by).orderBy(column)
    rows = df.dropna(subset=[by, column]).select(by, F.col(column).cast("double").alias("_x"), F.row_number().over(w).alias("_i"))
    n = F.count("*")
    return rows.groupBy(by).agg(F.try_divide(2 * F.sum(F.col("_i") * F.col("_x")) - (n + 1) * F.sum("_x"), n * F.sum("_x")).alias(f"{column}Gini"))


def holder_mean(df: DataFrame, by: str, column: str, rho: float = 1.0, mode: str = "paper") -> DataFrame:
    """<column>Holder: the mean of order rho, 0 the geometric one; mode "reference" divides outside the root."""
    df, keys = _grouped(df, by)
    x = F.col(column).cast("double")
    if rho == 0:
        return df.groupBy(*keys).agg(F.exp(F.avg(F.ln(x))).alias(f"{column}Holder"))
    value = F.pow(F.avg(F.pow(x, F.lit(rho))), F.lit(1 / rho)) if mode == "paper" else F.pow(F.sum(F.pow(x, F.lit(rho))), F.lit(1 / rho)) / F.count(x)
    return df.groupBy(*keys).agg(value.alias(f"{column}Holder"))
