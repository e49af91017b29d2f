"""Records of Web of Science, PubMed and DBLP by Spark's XML source, one row a record.

Schemas are given, so nothing is inferred and unused elements aren't parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarmill.functions import text as X


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("attributePrefix", "_").schema(schema).load(path)


_TEXT = "struct<_VALUE:string>"
_PUBMED = """MedlineCitation struct<
  PMID:struct<_VALUE:long>,
  Article:struct<
    Journal:struct<ISSN:struct<_VALUE:string>, Title:string, JournalIssue:struct<Volume:string, Issue:string, PubDate:struct<Year:int, Month:string, MedlineDate:string>>>,
    ArticleTitle:string, Abstract:struct<AbstractText:array<string>>, Language:string, ELocationID:array<struct<_EIdType:string, _VALUE:string>>,
    AuthorList:struct<Author:array<struct<LastName:string, ForeName:string, Initials:string, CollectiveName:string, AffiliationInfo:array<struct<Affiliation:string>>>>>,
    GrantList:struct<Grant:array<struct<GrantID:string, Acronym:string, Agency:string, Country:string>>>,
    PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>,
  MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_UI:string, _VALUE:string>>>>,
  ChemicalList:struct<Chemical:array<struct<NameOfSubstance:struct<_UI:string, _VALUE:string>>>>>,
PubmedData struct<ReferenceList:array<struct<Reference:array<struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string, _VALUE:string>>>>>>>>"""


def read_pubmed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """publication, publicationauthoraffiliation, pub2field, fieldinfo, pub2ref, pub2text and pub2grant of PubmedArticle records."""
    x = _xml(spark, path, "PubmedArticle", _PUBMED).select(F.col("MedlineCitation.PMID._VALUE").alias("PublicationId"), F.col("MedlineCitation.Article").alias("a"), F.col("MedlineCitation").alias("m"), F.col("PubmedData").alias("d"))
    issue = F.col("a.Journal.JournalIssue")
    year = F.coalesce(issue["PubDate"]["Year"], F.regexp_extract(issue["PubDate"]["MedlineDate"], r"([0-9]{4})", 1).try_cast("int"))
    doi = F.get(F.filter("a.ELocationID", lambda e: e["_EIdType"] == "doi"), F.lit(0))["_VALUE"]
    out = {"publication": x.select("PublicationId", year.alias("Year"), F.col("a.Journal.ISSN._VALUE").alias("JournalId"), F.col("a.Journal.Title").alias("JournalName"), F.col("a.ArticleTitle").alias("Title"), X.standard_doi(doi).alias("Doi"), issue["Volume"].alias("Volume"), issue["Issue"].alias("Issue"), F.array_join("a.PublicationTypeList.PublicationType._VALUE", ";").alias("DocType"), F.size(F.coalesce("a.AuthorList.Author", F.array())).alias("TeamSize"))}
    au = x.select("PublicationId", F.posexplode("a.AuthorList.Author").alias("i", "p"))
    au = au.select("PublicationId", (F.col("i") + 1).alias("AuthorSequence"), "p", F.explode_outer("p.AffiliationInfo.Affiliation").alias("OrigAffiliationName"))
    out["publicationauthoraffiliation"] = au.select("PublicationId", "AuthorSequence", F.coalesce("p.LastName", "p.CollectiveName").alias("LastName"), F.col("p.ForeName").alias("FirstName"), F.coalesce(F.nullif(F.concat_ws(" ", "p.ForeName", "p.LastName"), F.lit("")), "p.CollectiveName").alias("OrigAuthorName"), "OrigAffiliationName")
    terms = lambda c, n, k: x.select("PublicationId", F.explode(c).alias("f")).select("PublicationId", F.col(f"f.{n}._UI").alias("FieldId"), F.col(f"f.{n}._VALUE").alias("FieldName"), F.lit(k).alias("FieldType"))
    fields = terms("m.MeshHeadingList.MeshHeading", "DescriptorName", "mesh").union(terms("m.ChemicalList.Chemical", "NameOfSubstance", "chemical"))
    out["pub2field"] = fields.select("PublicationId", "FieldId", "FieldType")
    out["fieldinfo"] = fields.groupBy("FieldId", "FieldName", "FieldType").agg(F.countDistinct("PublicationId").alias("NumberPublications"))
    refs = x.select(F.col("PublicationId").alias("CitingPublicationId"), F.explode(F.flatten("d.ReferenceList.Reference")).alias("r")).select("CitingPublicationId", F.explode("r.ArticleIdList.ArticleId").alias("r"))
    out["pub2ref"] = refs.where("r._IdType = 'pubmed'").select("CitingPublicationId", X.to_int(F.col("r._VALUE")).alias("CitedPublicationId"))
    out["pub2text"] = x.select("PublicationId", F.col("a.Language").alias("Language"), F.col("a.ArticleTitle").alias("Title"), F.array_join(F.coalesce("a.Abstract.AbstractText", F.array().cast("array<string>")), " ").alias("Abstract"))
    out["pub2grant"] = x.select("PublicationId", F.explode("a.GrantList.Grant").alias("g")).select("PublicationId", "g.GrantID", "g.Acronym", "g.Agency", "g.Country")
    return out


_WOS = """UID string, static_data struct<
  summary:struct<pub_info:struct<_pubyear:int, _sortdate:string, _vol:string, _issue:string, page:struct<_begin:string, _end:string>>,
    titles:struct<title:array<struct<_type:string, _VALUE:string>>>, doctypes:struct<doctype:array<string>>,
    names:struct<name:array<struct<_seq_no:int, _role:string, _dais_id:string, _addr_no:string, display_name:string, last_name:string, first_name:string>>>>,
  fullrecord_metadata:struct<
    languages:struct<language:array<struct<_VALUE:string>>>,
    references:struct<reference:array<struct<uid:string>>>,
    addresses:struct<address_name:array<struct<address_spec:struct<_addr_no:string, full_address:string, city:string, country:string, organizations:struct<organization:array<struct<_pref:string, _VALUE:string>>>>>>>,
    category_info:struct<headings:struct<heading:array<string>>, subheadings:struct<subheading:array<string>>, subjects:struct<subject:array<struct<_ascatype:string, _VALUE:string>>>>,
    keywords:struct<keyword:array<string>>>,
  item:struct<keywords_plus:struct<keyword:array<string>>>>,
dynamic_data struct<cluster_related:struct<identifiers:struct<identifier:array<struct<_type:string, _value:string>>>>>"""


def _wos_id(c):
    return F.regexp_replace(c, "^WOS:", "")


def read_wos(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """publication, author, publicationauthoraffiliation, affiliation, pub2ref and pub2field of REC records; ids are texts without their prefix."""
    x = _xml(spark, path, "REC", _WOS).select(_wos_id(F.col("UID")).alias("PublicationId"), F.col("static_data.summary").alias("s"), F.col("static_data.fullrecord_metadata").alias("f"), F.col("static_data.item").alias("it"), F.col("dynamic_data.cluster_related.identifiers.identifier").alias("ids"))
    of = lambda c, kind: F.get(F.filter(c, lambda e: e["_type"] == kind), F.lit(0))
    info = F.col("s.pub_info")
    out = {"publication": x.select("PublicationId", info["_pubyear"].alias("Year"), of("ids", "issn")["_value"].alias("JournalId"), X.standard_doi(of("ids", "doi")["_value"]).alias("Doi"), of("ids", "pmid")["_value"].alias("PMID"), of("s.titles.title", "item")["_VALUE"].alias("Title"), of("s.titles.title", "source")["_VALUE"].alias("JournalName"), info["_sortdate"].try_cast("date").alias("Date"), info["_vol"].alias("Volume"), info["_issue"].alias("Issue"), info["page"]["_begin"].alias("FirstPage"), info["page"]["_end"].alias("LastPage"), F.get("s.doctypes.doctype", F.lit(0)).alias("DocType"))}
    n = x.select("PublicationId", F.explode("s.names.name").alias("n"), F.col("f.addresses.address_name").alias("adr")).where("n._role = 'author'")
    author = F.coalesce(F.col("n._dais_id"), F.lower("n.display_name"))
    n = n.withColumn("no", F.explode_outer(F.split("n._addr_no", " "))).withColumn("hit", F.get(F.filter("adr", lambda a: a["address_spec"]["_addr_no"] == F.col("no")), F.lit(0)))
    org = F.get("hit.address_spec.organizations.organization", F.lit(0))["_VALUE"]
    out["publicationauthoraffiliation"] = n.select("PublicationId", author.alias("AuthorId"), org.alias("AffiliationId"), F.col("n._seq_no").alias("AuthorSequence"), F.col("n.display_name").alias("OrigAuthorName"), F.col("hit.address_spec.full_address").alias("OrigAffiliationName"))
    out["author"] = n.groupBy(author.alias("AuthorId")).agg(F.min("n.display_name").alias("FullName"), F.min("n.last_name").alias("LastName"), F.min("n.first_name").alias("FirstName"), F.countDistinct("PublicationId").alias("NumberPublications"))
    a = x.select("PublicationId", F.explode("f.addresses.address_name.address_spec").alias("a"))
    out["affiliation"] = a.groupBy(F.get("a.organizations.organization", F.lit(0))["_VALUE"].alias("AffiliationId")).agg(F.min("a.full_address").alias("FullName"), F.min("a.city").alias("City"), F.min("a.country").alias("Country"), F.countDistinct("PublicationId").alias("NumberPublications"))
    out["pub2ref"] = x.select(F.col("PublicationId").alias("CitingPublicationId"), F.explode("f.references.reference.uid").alias("r")).select("CitingPublicationId", _wos_id(F.col("r")).alias("CitedPublicationId")).dropna()
    kinds = {"heading": "f.category_info.headings.heading", "subheading": "f.category_info.subheadings.subheading", "keyword": "f.keywords.keyword", "keywordplus": "it.keywords_plus.keyword"}
    parts = [x.select("PublicationId", F.explode(c).alias("FieldId")).withColumn("FieldType", F.lit(k)) for k, c in kinds.items()]
    parts.append(x.select("PublicationId", F.explode("f.category_info.subjects.subject").alias("u")).select("PublicationId", F.col("u._VALUE").alias("FieldId"), F.concat(F.lit("ASCA_"), "u._ascatype").alias("FieldType")))
    fields = parts[0]
    for p in parts[1:]:
        fields = fields.unionByName(p)
    out["pub2field"] = fields
    return out


_DBLP = "_key string, _publtype string, title string, year int, journal string, booktitle string, volume string, number string, pages string, ee array<string>, author array<string>, editor array<string>"
DBLP_TYPES = {"article": "j", "inproceedings": "c", "proceedings": "c", "book": "b", "incollection": "bc", "phdthesis": "t", "mastersthesis": "t"}


def read_dblp(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """publication, author, publicationauthoraffiliation and journal; ids are hashes of keys and names, so they don't depend on order. Web records are left out."""
    rows = None
    for tag, code in DBLP_TYPES.items():
        part = _xml(spark, path, tag, _DBLP).withColumn("DocType", F.lit(code))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("_key IS NOT NULL").withColumn("PublicationId", F.xxhash64("_key"))
    venue = F.coalesce("journal", "booktitle")
    out = {"publication": rows.select("PublicationId", F.col("_key").alias("DblpKey"), F.col("year").alias("Year"), F.xxhash64(venue).alias("JournalId"), F.col("title").alias("Title"), X.standard_doi(F.get(F.filter("ee", lambda e: e.contains("doi.org/")), F.lit(0))).alias("Doi"), F.col("volume").alias("Volume"), F.col("number").alias("Issue"), F.col("pages").alias("Pages"), "DocType", F.size(F.coalesce("author", F.array())).alias("TeamSize"))}
    a = rows.select("PublicationId", F.posexplode(F.coalesce("author", "editor")).alias("i", "n"))
    out["publicationauthoraffiliation"] = a.select("PublicationId", F.xxhash64("n").alias("AuthorId"), (F.col("i") + 1).alias("AuthorSequence"), F.col("n").alias("OrigAuthorName"))
    people = a.groupBy(F.xxhash64("n").alias("AuthorId"), F.col("n").alias("_n")).agg(F.countDistinct("PublicationId").alias("NumberPublications"))
    full = F.trim(F.regexp_replace("_n", r"\s+[0-9]{4}$", ""))  # namesakes have a number
    name = X.name_parts(full)
    out["author"] = people.select("AuthorId", full.alias("FullName"), *[name[p].alias(p) for p in ("LastName", "FirstName", "MiddleName")], "NumberPublications")
    out["journal"] = rows.where(venue.isNotNull()).select(F.xxhash64(venue).alias("JournalId"), venue.alias("FullName")).distinct()
    return out
