"""Readers, catalog and streams on small files made here."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scholarmill.catalog import Catalog
from scholarmill.operators import filters
from scholarmill.sources import aps, openalex, tabular, xmlrecords
from scholarmill.streaming import citations


def test_openalex(spark, tmp_path):
    def put(entity, *rows):
        p = tmp_path / "data" / entity / "updated_date=2024-01-02"
        p.mkdir(parents=True)
        with gzip.open(p / "part_000.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, rows)))

    w = "https://openalex.org/"
    put("works", {
        "id": w + "W1", "doi": "https://doi.org/10.1/X", "title": "T", "publication_year": 2020, "publication_date": "2020-02-03", "type": "article", "primary_location": {"source": {"id": w + "S5"}}, "referenced_works": [w + "W2", w + "W3"],
        "authorships": [{"author_position": "first", "author": {"id": w + "A1", "display_name": "Ada L"}, "institutions": [{"id": w + "I1", "display_name": "Inst"}, {"id": w + "I2"}]}, {"author_position": "last", "author": {"id": w + "A2"}, "institutions": []}],
        "abstract_inverted_index": {"b": [1], "a": [0]}, "topics": [{"id": w + "T7", "score": 0.5}], "grants": [{"funder": w + "F1", "award_id": "z"}],
    }, {"id": w + "W2", "authorships": [{"author_position": "middle", "author": {"id": w + "A9"}, "institutions": []}]})
    put("topics", {"id": w + "T7", "display_name": "t", "works_count": 3, "subfield": {"id": w + "subfields/12", "display_name": "s"}, "field": {"id": w + "fields/4", "display_name": "f"}, "domain": {"id": w + "domains/1", "display_name": "d"}})
    put("authors", {"id": w + "A1", "display_name": "Ada B. Lovelace", "works_count": 2, "cited_by_count": 5})
    for e in ("institutions", "sources", "funders"):
        put(e, {"id": w + "X3", "display_name": "n"})
    t = openalex.read_works(spark, str(tmp_path))
    p = t["publication"].orderBy("PublicationId").first()
    assert (p.PublicationId, p.Year, p.JournalId, p.Doi, p.TeamSize, str(p.Date)) == (1, 2020, 5, "10.1/x", 2, "2020-02-03")
    assert {tuple(r) for r in t["pub2ref"].collect()} == {(1, 2), (1, 3)}
    assert {(r.PublicationId, r.AuthorId, r.AffiliationId, r.AuthorSequence) for r in t["publicationauthoraffiliation"].collect()} == {(1, 1, 1, 1), (1, 1, 2, 1), (1, 2, None, 2), (2, 9, None, None)}
    assert t["pub2text"].orderBy("PublicationId").first().Abstract == "a b" and t["pub2grant"].first().FunderId == 1 and t["pub2field"].first().FieldId == 7
    assert openalex.read_works(spark, str(tmp_path), "1999-01-01")["publication"].count() == 0
    e = openalex.read_entities(spark, str(tmp_path))
    assert e["author"].first().LastName == "Lovelace" and {k: v.count() for k, v in e.items()} == {"affiliation": 1, "author": 1, "journal": 1, "funder": 1, "fieldinfo": 4, "fieldhierarchy": 3}
    assert tuple(openalex.expand_hierarchy(e["fieldhierarchy"], e["fieldinfo"].where("FieldLevel = 3")).first()) == (7, 12, 4, 1)
    s2 = tmp_path / "s2.json"
    s2.write_text(json.dumps({"authorid": "7", "name": "N", "aliases": ["a", "b"], "externalids": {"ORCID": ["1"]}, "papercount": 3, "hindex": 2}))
    assert openalex.read_semantic_scholar_authors(spark, str(s2)).first().Aliases == "a;b"


def test_tabular(spark, tmp_path):
    for name, n, row in (("mag/Affiliations", 12, {0: "1", 3: "U", 7: "5", 10: "1.5", 11: "x"}), ("mag/Authors", 8, {0: "2", 3: "Ada Lovelace", 4: "1"}), ("mag/Journals", 7, {0: "3", 3: "J"}), ("mag/Papers", 25, {0: "4", 3: "Journal", 4: 'A "quoted title', 7: "1999", 8: "1999-01-02", 11: "3"}), ("mag/PaperReferences", 2, {0: "4", 1: "5"}), ("mag/PaperAuthorAffiliations", 6, {0: "4", 1: "2", 3: "1"}), ("advanced/FieldsOfStudy", 8, {0: "9", 3: "F", 5: "1"}), ("advanced/PaperFieldsOfStudy", 3, {0: "4", 1: "9", 2: "0.5"})):
        p = tmp_path / f"{name}.txt"
        p.parent.mkdir(exist_ok=True)
        p.write_text("\t".join(row.get(i, "") for i in range(n)) + "\n")
    t = tabular.read_tables(spark, str(tmp_path))
    assert all(v.count() == 1 for v in t.values())
    p = t["publication"].first()
    assert (p.PublicationId, p.Year, p.DocType, p.Title, p.JournalId) == (4, 1999, "j", 'A "quoted title', 3)
    assert t["affiliation"].first().Longitude is None and t["author"].first().FirstName == "Ada"


def test_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text("""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><ISSN IssnType="Print">1-2</ISSN><JournalIssue><Volume>3</Volume><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle>
<Abstract><AbstractText>Abs.</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName><AffiliationInfo><Affiliation>U</Affiliation></AffiliationInfo></Author><Author><CollectiveName>C</CollectiveName></Author></AuthorList><GrantList><Grant><GrantID>g</GrantID><Country>X</Country></Grant></GrantList>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D5">Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ReferenceList><Reference><Citation>c</Citation><ArticleIdList><ArticleId IdType="pubmed">12</ArticleId><ArticleId IdType="doi">10</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>""")
    t = xmlrecords.read_pubmed(spark, str(tmp_path / "p.xml"))
    p = t["publication"].first()
    assert (p.PublicationId, p.Year, p.Title, p.TeamSize) == (11, 2001, "T", 2)
    assert tuple(t["pub2ref"].first()) == (11, 12) and t["pub2field"].first().FieldId == "D5" and t["pub2grant"].first().GrantID == "g" and t["pub2text"].first().Abstract == "Abs."
    assert {(r.OrigAuthorName, r.OrigAffiliationName) for r in t["publicationauthoraffiliation"].collect()} == {("F L", "U"), ("C", None)}
    (tmp_path / "d.xml").write_text("""<dblp><article key="a/1"><author>Ada Lovelace 0001</author><author>Bob</author><title>T</title><year>1990</year><journal>J</journal><ee>https://doi.org/10.5/Y</ee></article><inproceedings key="c/1"><author>Bob</author><title>U</title><year>1991</year><booktitle>B</booktitle></inproceedings><www key="w"><author>Zed</author></www></dblp>""")
    t = xmlrecords.read_dblp(spark, str(tmp_path / "d.xml"))
    assert {(r.Year, r.DocType, r.Doi) for r in t["publication"].collect()} == {(1990, "j", "10.5/y"), (1991, "c", None)}
    assert {(r.FullName, r.NumberPublications) for r in t["author"].collect()} == {("Ada Lovelace", 1), ("Bob", 2)}
    (tmp_path / "w.xml").write_text("""<records xmlns="http://x"><REC><UID>WOS:1</UID><static_data><summary><pub_info pubyear="2010" sortdate="2010-05-01" vol="2"/><titles><title type="source">J</title><title type="item">T</title></titles><names><name seq_no="1" role="author" dais_id="77" addr_no="1"><display_name>L, A</display_name></name></names><doctypes><doctype>Article</doctype></doctypes></summary>
<fullrecord_metadata><references><reference><uid>WOS:2</uid></reference></references><addresses><address_name><address_spec addr_no="1"><full_address>U, X</full_address><organizations><organization>U</organization></organizations></address_spec></address_name></addresses><category_info><headings><heading>Sci</heading></headings><subjects><subject ascatype="extended">Math</subject></subjects></category_info><keywords><keyword>k</keyword></keywords></fullrecord_metadata></static_data>
<dynamic_data><cluster_related><identifiers><identifier type="doi" value="10.9/Z"/></identifiers></cluster_related></dynamic_data></REC></records>""")
    t = xmlrecords.read_wos(spark, str(tmp_path / "w.xml"))
    p = t["publication"].first()
    assert (p.PublicationId, p.Year, p.Title, p.Doi) == ("1", 2010, "T", "10.9/z") and tuple(t["pub2ref"].first()) == ("1", "2")
    assert {tuple(r)[1:] for r in t["pub2field"].collect()} == {("Sci", "heading"), ("k", "keyword"), ("Math", "ASCA_extended")} and t["publicationauthoraffiliation"].first().AffiliationId == "U"


def test_aps(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("a/x.json", json.dumps({"id": "10.1/a", "date": "1999-03-04", "articleType": "review", "title": {"value": "T"}, "journal": {"id": "PR"}, "authors": [{"name": "A", "affiliationIds": ["a1"]}, {"name": "B"}], "affiliations": [{"id": "a1", "name": "U"}], "classificationSchemes": {"subjectAreas": [{"id": "q", "label": "Q"}]}}))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", "citing_doi,cited_doi\n10.1/a,10.1/b\n10.1/c,10.1/a\n")
    t = aps.read_aps(spark, str(tmp_path / "m.zip"), str(tmp_path / "c.zip"))
    p = t["publication"].first()
    assert (p.PublicationId, p.Year, p.DocType, p.TeamSize) == ("10.1/a", 1999, "rev", 2)
    assert {tuple(r) for r in t["pub2ref"].collect()} == {("10.1/a", "10.1/b"), ("10.1/c", "10.1/a")}
    assert sorted((r.Doi, r.Number) for r in aps.number_dois(t).collect()) == [("10.1/a", 0), ("10.1/b", 1), ("10.1/c", 2)]
    assert t["publicationauthoraffiliation"].where("AuthorSequence = 1").first().OrigAffiliationName == "U"


@pytest.mark.parametrize("extension", ["parquet", "csv.gz", "json"])
def test_catalog(spark, tmp_path, extension):
    c = Catalog(spark, str(tmp_path), extension)
    pub = spark.createDataFrame([(1, 2000, 'a "q"'), (1, 2001, "b"), (2, 2000, None), (None, 1, "n")], "PublicationId long, Year int, Title string")
    full = pub.select(*[F.col(f.name) if f.name in pub.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in __import__("scholarmill.schema", fromlist=["SCHEMAS"]).SCHEMAS["publication"]])
    c.save(full, "publication")
    c.save(spark.createDataFrame([(1, 2), (2, 3)], "CitingPublicationId long, CitedPublicationId long"), "pub2ref")
    got = c.load("publication", ["PublicationId", "Year", "Title"], dropna=["PublicationId"], duplicate_subset=["PublicationId"], duplicate_order=["Year"], source_file=True)
    assert {(r.PublicationId, r.Year) for r in got.collect()} == {(1, 2001), (2, 2000)} and got.first().filetag
    c.set_global_filters(filters.YearFilter(2000, 2000))
    assert {r[0] for r in c.publication_ids().collect()} == {1, 2} and c.pub2ref.count() == 1
    assert c.publication_info(spark.createDataFrame([(2,)], "PublicationId long"), ["PublicationId"]).count() == 1
    with pytest.raises(FileNotFoundError):
        Catalog(spark).load("publication")
    given = Catalog(spark, tables={"publication": pub}, keep_in_memory=True)
    assert given.pub.count() == 4 and given.load("publication", after=lambda d: d.where("Year > 2000")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, i % 3, f"2024-01-{1 + i % 20:02d} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "CitingPublicationId long, CitedPublicationId long, u string").select("CitingPublicationId", "CitedPublicationId", F.to_timestamp("u").alias("Updated"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = citations.citation_counts(citations.stream_works(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = df.select("CitingPublicationId", "CitedPublicationId").distinct().groupBy("CitedPublicationId").count()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
