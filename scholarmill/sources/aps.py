"""The American Physical Society's data sets: a zip of article JSON and one of citing and cited DOIs as CSV."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_ARTICLE = """id string, date string, articleType string, volume string, issue string, pageStart string, numPages int, title struct<value:string>, journal struct<id:string, name:string>,
authors array<struct<name:string, firstname:string, surname:string, affiliationIds:array<string>>>, affiliations array<struct<id:string, name:string>>,
classificationSchemes struct<subjectAreas:array<struct<id:string, label:string>>, physh:struct<disciplines:array<struct<id:string, label:string>>, concepts:array<struct<id:string, label:string>>>>"""
_TYPES = {"article": "j", "brief": "j", "rapid": "l", "letter": "l", "review": "rev", "reply": "l", "comment": "l", "editorial": "e", "erratum": "er"}


def _members(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(name, text) of the members of zip files; each file is unpacked by one task, a member at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if name.endswith(ending):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(name).decode("utf-8", "replace")])], ["name", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, text string")


def read_aps(spark: SparkSession, metadata: str, citations: str) -> dict[str, DataFrame]:
    """publication, publicationauthoraffiliation, affiliation, pub2field, fieldinfo and pub2ref; ids are DOIs."""
    x = _members(spark, metadata, ".json").select(F.from_json("text", _ARTICLE).alias("r")).select("r.*").where("id IS NOT NULL")
    kind = F.create_map(*[F.lit(v) for pair in _TYPES.items() for v in pair])
    out = {"publication": x.select(F.col("id").alias("PublicationId"), F.split("date", "-")[0].try_cast("int").alias("Year"), F.col("journal.id").alias("JournalId"), F.col("id").alias("Doi"), F.col("title.value").alias("Title"), F.col("date").try_cast("date").alias("Date"), F.col("volume").alias("Volume"), F.col("issue").alias("Issue"), F.coalesce(F.try_element_at(kind, "articleType"), "articleType").alias("DocType"), F.col("pageStart").alias("FirstPage"), F.size(F.coalesce("authors", F.array())).alias("TeamSize"))}
    a = x.select(F.col("id").alias("PublicationId"), "affiliations", F.posexplode("authors").alias("i", "a")).select("PublicationId", "affiliations", "i", "a", F.explode_outer("a.affiliationIds").alias("aff"))
    named = F.get(F.filter("affiliations", lambda v: v["id"] == F.col("aff")), F.lit(0))["name"]
    out["publicationauthoraffiliation"] = a.select("PublicationId", F.xxhash64(named).alias("AffiliationId"), (F.col("i") + 1).alias("AuthorSequence"), F.col("a.name").alias("OrigAuthorName"), named.alias("OrigAffiliationName"))
    out["affiliation"] = x.select(F.explode("affiliations.name").alias("FullName")).distinct().select(F.xxhash64("FullName").alias("AffiliationId"), "FullName")
    c = "classificationSchemes"
    fields = None
    for name, column in (("subjectArea", f"{c}.subjectAreas"), ("discipline", f"{c}.physh.disciplines"), ("concept", f"{c}.physh.concepts")):
        part = x.select(F.col("id").alias("PublicationId"), F.explode(column).alias("f")).select("PublicationId", F.col("f.id").alias("FieldId"), F.col("f.label").alias("FieldName"), F.lit(name).alias("FieldType"))
        fields = part if fields is None else fields.union(part)
    out["pub2field"] = fields.select("PublicationId", "FieldId", "FieldType")
    out["fieldinfo"] = fields.groupBy("FieldId", "FieldName", F.col("FieldType").alias("ClassificationType")).agg(F.countDistinct("PublicationId").alias("NumberPublications"))
    lines = _members(spark, citations, ".csv").select(F.explode(F.split("text", r"\r?\n")).alias("line")).where("line <> '' AND lower(line) NOT LIKE 'citing_doi%'")
    pair = F.split("line", ",")
    out["pub2ref"] = lines.select(F.trim(pair[0]).alias("CitingPublicationId"), F.trim(pair[1]).alias("CitedPublicationId"))
    return out


def number_dois(tables: dict[str, DataFrame]) -> DataFrame:
    """(Doi, Number): all DOIs of publications and references numbered from 0 in their order."""
    ids = tables["publication"].select(F.col("PublicationId").alias("Doi")).union(tables["pub2ref"].select("CitingPublicationId")).union(tables["pub2ref"].select("CitedPublicationId")).dropna().distinct()
    # Numbers go out by ranges, so that no task sees all ids.
    parts = ids.repartitionByRange("Doi").withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("Doi")))
    sizes = parts.groupBy("_p").agg(F.max("_i").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return parts.join(before, "_p").select("Doi", (F.col("_i") - 1 + F.col("_b")).alias("Number"))
