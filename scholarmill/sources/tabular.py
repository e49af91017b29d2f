"""Tab-separated dumps with columns by position, after the layout of the Microsoft Academic Graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.functions import text as X


def _columns(spark: SparkSession, path: str, n: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(n))
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def _int(i: int, name: str):
    return X.to_int(F.col(f"_c{i}")).alias(name)


def _text(i: int, name: str):
    return F.trim(f"_c{i}").alias(name)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of a dump with the folders mag and advanced, lazily; unreadable numbers are null."""
    out = {}
    a = _columns(spark, f"{root}/mag/Affiliations.txt", 12)
    out["affiliation"] = a.select(_int(0, "AffiliationId"), _int(7, "NumberPublications"), _int(8, "NumberCitations"), _text(3, "FullName"), _text(4, "GridId"), _text(5, "OfficialPage"), _text(6, "WikiPage"), X.to_float(F.col("_c10")).alias("Latitude"), X.to_float(F.col("_c11")).alias("Longitude"))
    a = _columns(spark, f"{root}/mag/Authors.txt", 8)
    name = X.name_parts(F.col("_c3"))
    out["author"] = a.select(_int(0, "AuthorId"), _int(4, "LastKnownAffiliationId"), _int(5, "NumberPublications"), _int(7, "NumberCitations"), _text(3, "FullName"), *[name[p].alias(p) for p in ("LastName", "FirstName", "MiddleName")])
    a = _columns(spark, f"{root}/mag/Journals.txt", 7)
    out["journal"] = a.select(_int(0, "JournalId"), _text(3, "FullName"), _text(4, "Issn"), _text(5, "Publisher"), _text(6, "Webpage"))
    a = _columns(spark, f"{root}/mag/Papers.txt", 25)
    out["publication"] = a.select(_int(0, "PublicationId"), X.to_int(F.col("_c7")).cast("int").alias("Year"), _int(11, "JournalId"), _int(22, "FamilyId"), _text(2, "Doi"), _text(4, "Title"), F.col("_c8").try_cast("date").alias("Date"), _text(14, "Volume"), _text(15, "Issue"), X.doc_type(F.col("_c3")).alias("DocType"), _text(16, "FirstPage"), _text(17, "LastPage"))
    out["pub2ref"] = _columns(spark, f"{root}/mag/PaperReferences.txt", 2).select(_int(0, "CitingPublicationId"), _int(1, "CitedPublicationId"))
    a = _columns(spark, f"{root}/mag/PaperAuthorAffiliations.txt", 6)
    out["publicationauthoraffiliation"] = a.select(_int(0, "PublicationId"), _int(1, "AuthorId"), _int(2, "AffiliationId"), X.to_int(F.col("_c3")).cast("int").alias("AuthorSequence"), _text(4, "OrigAuthorName"), _text(5, "OrigAffiliationName"))
    a = _columns(spark, f"{root}/advanced/FieldsOfStudy.txt", 8)
    out["fieldinfo"] = a.select(_int(0, "FieldId"), X.to_int(F.col("_c5")).cast("int").alias("FieldLevel"), _int(6, "NumberPublications"), _text(3, "FieldName"))
    out["pub2field"] = _columns(spark, f"{root}/advanced/PaperFieldsOfStudy.txt", 3).select(_int(0, "PublicationId"), _int(1, "FieldId"), X.to_float(F.col("_c2")).alias("Score"))
    return out
