"""Canonical table schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


class MetricError(ValueError):
    """An operator was asked for something it doesn't define."""


_KINDS = {"long": LongType, "int": IntegerType, "double": DoubleType, "string": StringType, "date": DateType, "boolean": BooleanType}


def _table(spec: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]()) for name, kind in (x.split(":") for x in spec.split())])


SCHEMAS = {
    "publication": _table("PublicationId:long Year:int JournalId:long FamilyId:long Doi:string Title:string Date:date Volume:string Issue:string DocType:string TeamSize:int"),
    "author": _table("AuthorId:long LastKnownAffiliationId:long NumberPublications:long NumberCitations:long FullName:string LastName:string FirstName:string MiddleName:string"),
    "affiliation": _table("AffiliationId:long NumberPublications:long NumberCitations:long FullName:string GridId:string OfficialPage:string WikiPage:string Latitude:double Longitude:double"),
    "journal": _table("JournalId:long FullName:string Issn:string Publisher:string Webpage:string"),
    "pub2ref": _table("CitingPublicationId:long CitedPublicationId:long"),
    "publicationauthoraffiliation": _table("PublicationId:long AuthorId:long AffiliationId:long AuthorSequence:int OrigAuthorName:string OrigAffiliationName:string"),
    "pub2field": _table("PublicationId:long FieldId:long Score:double"),
    "fieldinfo": _table("FieldId:long FieldLevel:int NumberPublications:long FieldName:string"),
    "fieldhierarchy": _table("ParentFieldId:long ChildFieldId:long"),
    "pub2text": _table("PublicationId:long Language:string Title:string Abstract:string"),
    "pub2grant": _table("PublicationId:long FunderId:long AwardId:string"),
    "funder": _table("FunderId:long WikiDataId:string RORId:string FullName:string HomePage:string Country:string NumberGrants:long NumberPublications:long NumberCitations:long"),
    "temporalimpact": _table("PublicationId:long CitingYear:int YearlyCitations:long CitedYear:int"),
}

#: Codes of document types by their names.
DOC_TYPES = {"Journal": "j", "Book": "b", "BookChapter": "bc", "Conference": "c", "Dataset": "d", "Patent": "p", "Repository": "r", "Thesis": "t", "Review": "rev", "Letter": "l"}


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df itself; raises KeyError if it lacks a column."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise KeyError(f"columns {lacking} are not among {df.columns}")
    return df
