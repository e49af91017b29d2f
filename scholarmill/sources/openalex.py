"""JSON lines under data/<entity>/updated_date=*/ of OpenAlex snapshots, and authors of Semantic Scholar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.functions import text as X

_ENTITY = "id string, display_name string"
_WORK = f"""id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, language string, is_retracted boolean,
biblio struct<volume:string, issue:string, first_page:string, last_page:string>, ids struct<pmid:string>, primary_location struct<source:struct<id:string>>, host_venue struct<id:string>,
referenced_works array<string>, abstract_inverted_index map<string, array<int>>,
authorships array<struct<author_position:string, author:struct<id:string, display_name:string>, institutions:array<struct<id:string, display_name:string>>, is_corresponding:boolean, raw_affiliation_string:string>>,
topics array<struct<id:string, score:double>>, concepts array<struct<id:string, score:double>>, grants array<struct<funder:string, award_id:string>>"""


def _read(spark: SparkSession, root: str, entity: str, schema: str, updated: str | None) -> DataFrame:
    df = spark.read.schema(schema + ", updated_date date").json(f"{root}/data/{entity}")
    return df if updated is None else df.where(F.col("updated_date") == F.lit(updated).cast("date"))


def read_works(spark: SparkSession, root: str, updated: str | None = None) -> dict[str, DataFrame]:
    """Tables that works give; `updated` reads one partition only. Unused columns aren't parsed."""
    w = _read(spark, root, "works", _WORK, updated).withColumn("PublicationId", X.openalex_id(F.col("id")))
    out = {}
    out["publication"] = w.select(
        "PublicationId", F.col("publication_year").alias("Year"), X.openalex_id(F.coalesce("primary_location.source.id", "host_venue.id")).alias("JournalId"), X.standard_doi(F.col("doi")).alias("Doi"), F.coalesce("title", "display_name").alias("Title"), F.col("publication_date").try_cast("date").alias("Date"),
        F.col("biblio.volume").alias("Volume"), F.col("biblio.issue").alias("Issue"), F.col("biblio.first_page").alias("FirstPage"), F.col("biblio.last_page").alias("LastPage"), F.col("type").alias("DocType"), F.size(F.coalesce("authorships", F.array())).alias("TeamSize"), F.col("language").alias("Language"), X.openalex_id(F.col("ids.pmid")).alias("PMID"), F.col("is_retracted").alias("IsRetracted"),
    )
    out["pub2ref"] = w.select(F.col("PublicationId").alias("CitingPublicationId"), F.explode("referenced_works").alias("r")).select("CitingPublicationId", X.openalex_id(F.col("r")).alias("CitedPublicationId"))
    a = w.select("PublicationId", (F.get("authorships", F.lit(0))["author_position"] == "first").alias("ordered"), F.posexplode("authorships").alias("i", "a"))
    a = a.select("PublicationId", "ordered", "i", "a", F.explode_outer("a.institutions").alias("inst"))
    out["publicationauthoraffiliation"] = a.select(
        "PublicationId", X.openalex_id(F.col("a.author.id")).alias("AuthorId"), X.openalex_id(F.col("inst.id")).alias("AffiliationId"), F.when(F.col("ordered"), F.col("i") + 1).alias("AuthorSequence"), F.col("a.author_position").alias("AuthorPosition"), F.col("a.author.display_name").alias("OrigAuthorName"),
        F.col("inst.display_name").alias("OrigAffiliationName"), F.col("a.is_corresponding").alias("IsCorresponding"), F.col("a.raw_affiliation_string").alias("RawAffiliationString"),
    )
    fields = lambda c: w.select("PublicationId", F.explode(c).alias("f")).select("PublicationId", X.openalex_id(F.regexp_extract("f.id", r"([0-9]+)$", 1)).alias("FieldId"), F.col("f.score").alias("Score"), F.lit(c[:-1]).alias("FieldType"))
    out["pub2field"] = fields("topics").union(fields("concepts"))
    out["pub2grant"] = w.select("PublicationId", F.explode("grants").alias("g")).select("PublicationId", X.openalex_id(F.col("g.funder")).alias("FunderId"), F.col("g.award_id").alias("AwardId"))
    out["pub2text"] = w.select("PublicationId", F.col("language").alias("Language"), F.coalesce("title", "display_name").alias("Title"), X.abstract_text(F.col("abstract_inverted_index")).alias("Abstract"))
    return out


def read_entities(spark: SparkSession, root: str, updated: str | None = None) -> dict[str, DataFrame]:
    """affiliation, author, journal, funder, fieldinfo and fieldhierarchy."""
    out = {}
    x = _read(spark, root, "institutions", _ENTITY + ", works_count long, cited_by_count long, homepage_url string, ror string, type string, ids struct<grid:string, wikipedia:string>, geo struct<latitude:double, longitude:double, country:string, city:string, region:string>", updated)
    out["affiliation"] = x.select(X.openalex_id(F.col("id")).alias("AffiliationId"), F.col("works_count").alias("NumberPublications"), F.col("cited_by_count").alias("NumberCitations"), F.col("display_name").alias("FullName"), F.col("ids.grid").alias("GridId"), F.col("homepage_url").alias("OfficialPage"), F.col("ids.wikipedia").alias("WikiPage"), F.col("geo.latitude").alias("Latitude"), F.col("geo.longitude").alias("Longitude"), F.col("type").alias("InstitutionType"), F.col("ror").alias("RORId"), F.col("geo.country").alias("Country"), F.col("geo.city").alias("City"), F.col("geo.region").alias("Region"))
    x = _read(spark, root, "authors", _ENTITY + ", works_count long, cited_by_count long, orcid string, last_known_institution struct<id:string>, ids struct<wikipedia:string>", updated)
    name = X.name_parts(F.col("display_name"))
    out["author"] = x.select(X.openalex_id(F.col("id")).alias("AuthorId"), X.openalex_id(F.col("last_known_institution.id")).alias("LastKnownAffiliationId"), F.col("works_count").alias("NumberPublications"), F.col("cited_by_count").alias("NumberCitations"), F.col("display_name").alias("FullName"), *[name[p].alias(p) for p in ("LastName", "FirstName", "MiddleName")], F.regexp_extract("orcid", r"([0-9X-]{19})$", 1).alias("ORCID"), F.col("ids.wikipedia").alias("WikiPage"))
    x = _read(spark, root, "sources", _ENTITY + ", issn_l string, issn array<string>, host_organization_name string, homepage_url string, type string, country_code string, is_oa boolean", updated)
    out["journal"] = x.select(X.openalex_id(F.col("id")).alias("JournalId"), F.col("display_name").alias("FullName"), F.col("issn").alias("Issn"), F.col("issn_l").alias("ISSN_l"), F.col("host_organization_name").alias("Publisher"), F.col("homepage_url").alias("Webpage"), F.col("type").alias("Type"), F.col("country_code").alias("Country"), F.col("is_oa").alias("IsOpenAccess"))
    x = _read(spark, root, "funders", _ENTITY + ", ids struct<wikidata:string, ror:string>, homepage_url string, country_code string, grants_count long, works_count long, cited_by_count long", updated)
    out["funder"] = x.select(X.openalex_id(F.col("id")).alias("FunderId"), F.col("ids.wikidata").alias("WikiDataId"), F.col("ids.ror").alias("RORId"), F.col("display_name").alias("FullName"), F.col("homepage_url").alias("HomePage"), F.col("country_code").alias("Country"), F.col("grants_count").alias("NumberGrants"), F.col("works_count").alias("NumberPublications"), F.col("cited_by_count").alias("NumberCitations"))
    part = "struct<id:string, display_name:string>"
    x = _read(spark, root, "topics", _ENTITY + f", works_count long, subfield {part}, field {part}, domain {part}", updated)
    num = lambda c: X.openalex_id(F.regexp_extract(c, r"([0-9]+)$", 1))
    out["fieldinfo"] = x.select(num("id").alias("FieldId"), F.lit(3).alias("FieldLevel"), F.col("works_count").alias("NumberPublications"), F.col("display_name").alias("FieldName"), F.lit("topic").alias("FieldType"))
    for level, c in ((2, "subfield"), (1, "field"), (0, "domain")):
        more = x.groupBy(num(f"{c}.id").alias("FieldId"), F.col(f"{c}.display_name").alias("FieldName")).agg(F.sum("works_count").alias("NumberPublications"))
        out["fieldinfo"] = out["fieldinfo"].unionByName(more.select("FieldId", F.lit(level).alias("FieldLevel"), "NumberPublications", "FieldName", F.lit(c).alias("FieldType")))
    pairs = F.explode(F.array(*[F.struct(num(p).alias("ParentFieldId"), num(c).alias("ChildFieldId")) for p, c in (("subfield.id", "id"), ("field.id", "subfield.id"), ("domain.id", "field.id"))]))
    out["fieldhierarchy"] = x.select(pairs.alias("p")).select("p.*").dropna().distinct()
    return out


def expand_hierarchy(hierarchy: DataFrame, topics: DataFrame) -> DataFrame:
    """(TopicId, SubFieldId, FieldId, DomainId) by two more steps from child to parent; ids of the levels must be apart."""
    up = lambda child, parent: hierarchy.select(F.col("ChildFieldId").alias(child), F.col("ParentFieldId").alias(parent))
    out = topics.select(F.col("FieldId").alias("TopicId")).distinct().join(up("TopicId", "SubFieldId"), "TopicId").join(up("SubFieldId", "FieldId"), "SubFieldId").join(up("FieldId", "DomainId"), "FieldId")
    return out.select("TopicId", "SubFieldId", "FieldId", "DomainId")


def read_semantic_scholar_authors(spark: SparkSession, path: str) -> DataFrame:
    """Authors with their outside ids joined by semicolons."""
    x = spark.read.schema("authorid string, name string, aliases array<string>, externalids struct<ORCID:array<string>, DBLP:array<string>>, papercount long, citationcount long, hindex long, url string, homepage string").json(path)
    return x.select(X.to_int(F.col("authorid")).alias("AuthorId"), F.col("name").alias("FullName"), F.array_join("aliases", ";").alias("Aliases"), F.array_join("externalids.ORCID", ";").alias("ORCID"), F.array_join("externalids.DBLP", ";").alias("DBLP"), F.col("papercount").alias("NumberPublications"), F.col("citationcount").alias("NumberCitations"), F.col("hindex").alias("Hindex"), F.col("homepage").alias("WebPage"))
