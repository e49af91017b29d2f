"""Cross-document line frequency: lines that too many documents of a host share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarmill.session import cut_lineage

#: A line is boilerplate on a host if more documents than both of these have it.
MIN_DOCS, MAX_SHARE = 5, 0.01
#: A line of at least LONG characters is boilerplate also if more than MANY_DOCS documents of a host have it, however large the host is.
MANY_DOCS, LONG = 50, 20
#: A document is depleted if less than this share of its characters in lines is left.
MIN_KEPT = 0.5
#: Boilerplate lines, 24 bytes each, are broadcast if a host has at most so many and all hosts have; else the lines of documents are joined with them.
HOST_ROWS, BROADCAST_ROWS = 2_000, 500_000


def normal_line(line: Column) -> Column:
    """Lower case, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\x0B\f]{2,}|[\t\r\x0B\f]", " "))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, line_hash, n_docs, host_docs) of the lines above the limits.

    A line is above them with more than min_docs documents, if these are more
    than max_share of the host's, or more than many_docs and the line is LONG.

    Documents are distinct by their text: copies of one document count once, so
    that a document isn't boilerplate for having been copied whole. A null host
    is a host of its own. Blank lines don't count. Only hashes of lines are
    shuffled, once per document that has the line.
    """
    hashes = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line_hash"), (F.length(x) >= LONG).alias("long"))))
    lines = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("whole"), F.explode(hashes).alias("line")).select("host", "whole", "line.*")
    count = lines.groupBy("host", "line_hash", "long").agg(F.countDistinct("whole").alias("n_docs"))
    sizes = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("whole")).groupBy("host").agg(F.countDistinct("whole").alias("host_docs"))
    over = count.where(F.col("n_docs") > min_docs).join(sizes.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return over.where((F.col("n_docs") > max_share * F.col("host_docs")) | (F.col("long") & (F.col("n_docs") > many_docs))).drop("long")


def line_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT, many_docs: int = MANY_DOCS) -> DataFrame:
    """docs without boilerplate lines and without the documents that these deplete.

    Keeps the columns of docs and their order, text cleaned. A document is
    rejected if nothing is left of it, or less than min_kept of the characters
    of its normalised lines: so null, empty and blank texts go. If
    more than half of the texts of a host that have a line are depleted and
    have no longer boilerplate line, these are copies of each other and not
    documents with some boilerplate: the first by key, nulls first, and MD5 of
    the text stays whole, with all rows that repeat it. So a group of near
    copies of any size leaves one.
    Every other row is judged by itself: repeated rows stay repeated. A text
    without boilerplate stays as it is, blank lines too. A null host is a host
    of its own. An empty table gives an empty result.
    """
    names = docs.columns
    bad = cut_lineage(boilerplate(docs, text, host, min_docs, max_share, many_docs).select("host", "line_hash", "n_docs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.col(host).alias("h"), F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), normal_line(x).alias("normal"))).alias("lines"))
    # A text's lines are searched for among all of its host's.
    most = bad.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    few = (most[0] or 0) <= HOST_ROWS and (most[1] or 0) <= BROADCAST_ROWS
    if few:
        by_host = bad.groupBy(F.col("host").alias("bad_host")).agg(F.collect_set("line_hash").alias("bad"))
        rows = rows.join(F.broadcast(by_host), F.col("h").eqNullSafe(F.col("bad_host")), "left")
    else:
        # The boilerplate of each document that has any, by a fingerprint of the document.
        mark = F.xxhash64(*[F.col(c) for c in (key, text, host)])
        hashes = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.xxhash64(normal_line(x))))
        hit = docs.select(mark.alias("hit_mark"), F.col(host).alias("h"), F.explode(hashes).alias("l"))
        hit = hit.join(bad, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line_hash"))).groupBy("hit_mark").agg(F.collect_set("l").alias("bad"))
        rows = rows.withColumn("mark", F.xxhash64(*[F.col("d").getField(c) for c in (key, text, host)])).join(hit, F.col("mark") == F.col("hit_mark"), "left")
    is_bad = lambda x: F.coalesce(F.array_contains("bad", F.xxhash64(x["normal"])), F.lit(False))
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x["normal"]))
    rows = rows.select("d", "h", "lines", "bad", F.filter("lines", lambda x: ~is_bad(x)).alias("kept"))
    depleted = (size("kept") == 0) | (size("kept") < min_kept * size("lines"))
    old = F.col("d").getField(text)
    rows = rows.where(size("lines") > 0).withColumn("depleted", depleted).withColumn("digest", F.when(F.col("depleted"), F.md5(old.cast("binary"))))
    # One for each boilerplate line at most.
    longest = F.array_max(F.transform(F.filter("lines", is_bad), lambda x: F.struct(F.length(x["normal"]).alias("n"), x["normal"].alias("line"))))
    whole = rows.where("depleted").select("h", F.xxhash64(longest["line"]).alias("l"), F.col("d").getField(key).alias("key"), "digest")
    whole = whole.groupBy("h", "l").agg(F.min(F.struct("key", "digest")).alias("first"), F.countDistinct("digest").alias("n"))
    whole = whole.join(bad, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line_hash"))).where(F.col("n") * 2 > F.col("n_docs"))
    whole = cut_lineage(whole.select("h", "first.*").toDF("whole_host", "whole_key", "whole_digest"))
    same = F.col("h").eqNullSafe(F.col("whole_host")) & F.col("d").getField(key).eqNullSafe(F.col("whole_key")) & (F.col("digest") == F.col("whole_digest"))
    rows = rows.join(F.broadcast(whole) if few else whole.hint("shuffle_hash"), same, "left").where(~F.col("depleted") | F.col("whole_digest").isNotNull())
    cleaned = F.when(F.col("depleted") | (F.size("kept") == F.size("lines")), old).otherwise(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))
    return rows.select(*[cleaned.alias(c) if c == text else F.col("d").getField(c).alias(c) for c in names])


#: DuckDB SQL for line_quality(documents) with the limits above.
ORACLE_SQL = rf"""
WITH d AS (SELECT *, row_number() OVER () AS rid, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT rid, source, text, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
n AS (SELECT *, trim(regexp_replace(lower(line), '[ \t\r\x0B\f]{{2,}}|[\t\r\x0B\f]', ' ', 'g')) AS norm FROM l),
bad AS (
  SELECT n.source, n.norm, count(DISTINCT text) AS n_docs FROM n
  JOIN (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY 1) s ON n.source IS NOT DISTINCT FROM s.source
  WHERE norm <> '' GROUP BY n.source, n.norm
  HAVING count(DISTINCT text) > {MIN_DOCS} AND (count(DISTINCT text) > {MAX_SHARE} * max(host_docs) OR length(norm) >= {LONG} AND count(DISTINCT text) > {MANY_DOCS})),
m AS (
  SELECT n.*, NOT EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM n.source AND b.norm = n.norm) AS keep FROM n),
k AS (
  SELECT rid, sum(length(norm)) AS before, coalesce(sum(length(norm)) FILTER (keep), 0) AS after, bool_and(keep) AS whole,
         string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS cleaned, max(struct_pack(n := length(norm), s := norm)) FILTER (NOT keep) AS longest
  FROM m GROUP BY rid),
j AS (SELECT d.*, k.*, NOT (after > 0 AND after >= {MIN_KEPT} * before) AS depleted FROM d JOIN k USING (rid) WHERE before > 0),
o AS (SELECT *, rank() OVER (PARTITION BY depleted, source, longest ORDER BY doc_id NULLS FIRST, md5(text)) AS place,
         count(DISTINCT md5(text)) OVER (PARTITION BY depleted, source, longest) AS alike FROM j)
SELECT doc_id, CASE WHEN whole OR depleted THEN text ELSE cleaned END AS text, lang, source, n_chars FROM o
WHERE NOT depleted OR place = 1 AND alike * 2 > (SELECT max(n_docs) FROM bad b WHERE b.source IS NOT DISTINCT FROM o.source AND b.norm = o.longest.s)
"""
