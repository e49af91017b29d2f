"""The driver's tables read as a bibliometric model: orders are publications, suppliers authors, parts the cited ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.session import spread, table


def pub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("PublicationId"),
        F.year("o_orderdate").alias("Year"),
        F.to_date("o_orderdate").alias("Date"),
        F.col("o_custkey").alias("JournalId"),
        F.col("o_orderstatus").alias("DocType"),
    )


def paa(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("PublicationId"),
        F.col("l_suppkey").alias("AuthorId"),
        F.col("s_nationkey").alias("AffiliationId"),
        F.col("l_linenumber").alias("AuthorSequence"),
    )


def author2pub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("AuthorId"), F.col("l_orderkey").alias("PublicationId")).dropna(), "PublicationId").distinct()


def pub2ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_orderkey <> l_partkey")
    return spread(items.select(F.col("l_orderkey").alias("CitingPublicationId"), F.col("l_partkey").alias("CitedPublicationId")), "CitingPublicationId").distinct()


def dated_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pub2ref with CitingYear and CitedYear."""
    year = pub(spark, sf_dir).select("PublicationId", "Year")
    citing = year.select(F.col("PublicationId").alias("CitingPublicationId"), F.col("Year").alias("CitingYear"))
    cited = year.select(F.col("PublicationId").alias("CitedPublicationId"), F.col("Year").alias("CitedYear"))
    return spread(pub2ref(spark, sf_dir).join(citing, "CitingPublicationId"), "CitedPublicationId").join(cited, "CitedPublicationId")


def pub2field(spark: SparkSession, sf_dir: str, field: str = "p_brand") -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", field)
    return spread(items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("PublicationId"), F.col(field).alias("FieldId")), "PublicationId").distinct()


#: The same in SQL, as common table expressions.
CTE = """
pub AS (SELECT o_orderkey AS PublicationId, CAST(year(o_orderdate) AS INTEGER) AS Year, CAST(o_orderdate AS DATE) AS Date, o_custkey AS JournalId, o_orderstatus AS DocType FROM orders),
paa AS (SELECT l_orderkey AS PublicationId, l_suppkey AS AuthorId, s_nationkey AS AffiliationId, l_linenumber AS AuthorSequence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
a2p AS (SELECT DISTINCT l_suppkey AS AuthorId, l_orderkey AS PublicationId FROM lineitem),
e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey <> l_partkey),
ey AS (SELECT e.a, e.b, p.Year AS cy, q.Year AS py FROM e JOIN pub p ON p.PublicationId = e.a JOIN pub q ON q.PublicationId = e.b),
p2f AS (SELECT DISTINCT l_orderkey AS PublicationId, p_brand AS FieldId FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
