"""Matching of publications by title, and networks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scholarmill.functions.text import indel_ratio, strip_accents
from scholarmill.session import cut_lineage, spread

#: Common English words, left out of word networks unless others are given.
STOP_WORDS = tuple("a about after all also an and any are as at be because been but by can could did do does each for from had has have he her his how i if in into is it its just like may more most no not of on one or other our out over she should so some such than that the their them then there these they this those through to too under up use very was we were what when where which while who will with would you your".split())


def align_publications(left: DataFrame, right: DataFrame | None = None, exact: list[str] | None = None, approximate: str | None = "Title", key: str = "PublicationId", ntop: int = 1, min_cosine: float = 0.75, min_ratio: float = 0.9) -> DataFrame:
    """(<key>, match, Cosine, Ratio): for each row of left the best match of right, or none.

    Without an approximate column, the least id that is equal in the exact
    columns. Else, within equal exact columns, titles by the cosine of their
    three-letter TF-IDF vectors (weights from left), the best ntop of at least
    min_cosine, and of these the best by the ratio of common letters, at least
    min_ratio. right None matches left with itself, ids apart. Nulls match nothing.

    Equal titles are searched once. A pair of min_cosine must share one of the
    rarest letters of both, those without which the rest of the vector is
    shorter than min_cosine; only pairs that do are compared, without a loss.
    Cosines count as equal to twelve digits, and the least id is taken.
    """
    exact = ["Year"] if exact is None else exact
    own = right is None
    right = left if own else right
    need = [key, *exact, *([approximate] if approximate else [])]
    a = left.select(*need).dropna()
    b = right.select(F.col(key).alias("match"), *exact, *([F.col(approximate).alias("_other")] if approximate else [])).dropna()
    differ = F.col(key) != F.col("match") if own else F.lit(True)
    if not approximate:
        return a.join(b, exact).where(differ).groupBy(key).agg(F.min("match").alias("match"))

    # Titles with their exact columns: what has the same is one text, with a 128-bit name.
    def texts(df: DataFrame, id_: str, text: str) -> DataFrame:
        rows = df.groupBy(id_, *exact).agg(F.array_sort(F.collect_list(text)).alias("_t"))
        return rows.withColumn("_p", F.md5(F.to_json(F.struct(*exact, "_t")).cast("binary")))

    mine = cut_lineage(texts(a, key, approximate))
    theirs = mine.withColumnRenamed(key, "match") if own else cut_lineage(texts(b, "match", "_other"))

    def grams(rows: DataFrame) -> DataFrame:
        each = rows.select("_p", F.explode("_t").alias("_x")).where(F.length("_x") >= 3)
        each = each.select("_p", F.explode(F.transform(F.sequence(F.lit(1), F.length("_x") - 2), lambda i: F.substring(F.col("_x"), i, F.lit(3)))).alias("g"))
        return each.groupBy("_p", "g").agg(F.count("*").alias("tf"))

    left_texts = mine.groupBy("_p").agg(F.count("*").alias("_m"), *(F.first(c).alias(c) for c in [*exact, "_t"]))
    right_texts = left_texts if own else theirs.groupBy("_p").agg(*(F.first(c).alias(c) for c in [*exact, "_t"]))
    ga = grams(left_texts)
    n = a.agg(F.count("*").alias("_n"))
    df = ga.join(left_texts.select("_p", "_m"), "_p").groupBy("g").agg(F.sum("_m").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("g", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weighted(rows: DataFrame, g: DataFrame) -> DataFrame:
        """(_p, _v: weights of letters, _rare: the rarest letters, exact)."""
        w = spread(g.join(idf, "g").withColumn("_w", F.col("tf") * F.col("idf")), "_p")
        of = Window.partitionBy("_p")
        w = w.withColumn("_w", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(of)))
        rarer = F.sum(F.col("_w") * F.col("_w")).over(of.orderBy(F.desc("idf"), "g").rowsBetween(Window.unboundedPreceding, -1))
        w = w.withColumn("_rest", 1 - F.coalesce(rarer, F.lit(0.0)))
        rare = F.when(F.col("_rest") >= max(0.0, min_cosine - 1e-9) ** 2 - 1e-12, F.col("g"))
        vectors = w.groupBy("_p").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "_w")))).alias("_v"), F.collect_list(rare).alias("_rare"))
        return cut_lineage(vectors.join(rows.select("_p", *exact), "_p"))

    va = weighted(left_texts, ga)
    vb = va if own else weighted(right_texts, grams(right_texts))
    x = spread(va.select("_p", *exact, "_v", F.explode("_rare").alias("g")), *exact, "g")
    y = spread(vb.select("_p", *exact, "_v", F.explode("_rare").alias("g")), *exact, "g").withColumnsRenamed({"_p": "_q", "_v": "_u"})
    # Of texts of one table, each pair is compared once, and each text with itself.
    compared = x.join(y, [*exact, "g"])
    if own:
        compared = compared.where("_p < _q")
    dot = F.aggregate(F.map_entries("_v"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("_u", e["key"]), F.lit(0.0)))
    pairs = compared.select("_p", "_q", F.round(dot, 12).alias("Cosine")).where(F.col("Cosine") >= min_cosine).distinct()
    if own:
        itself = va.select("_p", F.col("_p").alias("_q"), F.lit(1.0).alias("Cosine"))
        pairs = pairs.select("_p", F.explode(F.array(F.struct("_p", "_q"), F.struct(F.col("_q").alias("_p"), F.col("_p").alias("_q")))).alias("_x"), "Cosine").select("_x._p", "_x._q", "Cosine").union(itself)
    # One more than asked for, as a row isn't its own match.
    ids = theirs.groupBy(F.col("_p").alias("_q")).agg(F.slice(F.array_sort(F.collect_set("match")), 1, ntop + 1).alias("_ids"), F.first("_t")[0].alias("_other"))
    named = pairs.join(ids, "_q").select("_p", "Cosine", "_other", F.explode("_ids").alias("match"))
    top = named.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("Cosine"), "match"))).where(F.col("_r") <= ntop + 1)
    named = mine.select(key, "_p", F.col("_t")[0].alias("_mine")).join(top.drop("_r"), "_p").where(differ)
    named = named.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("Cosine"), "match"))).where(F.col("_r") <= ntop)
    checked = named.withColumn("Ratio", indel_ratio("_mine", "_other")).where(F.col("Ratio") >= min_ratio)
    best = Window.partitionBy(key).orderBy(F.desc("Ratio"), F.desc("Cosine"), "match")
    return checked.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "match", "Cosine", "Ratio")


def coword_network(df: DataFrame, text: str = "Title", key: str = "PublicationId", stop_words=STOP_WORDS, accents: bool = True, lower: bool = True, least: int = 1, vocabulary: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight), src <= dst: products of the counts of two words, added up over texts; src = dst has the squares.

    Words have two letters or digits at least; those in fewer than `least`
    texts, stop words, and with a vocabulary (a table of words) all others
    are left out. Repeated rows count once.
    """
    rows = df.select(key, F.col(text).alias("_t")).dropna().distinct()
    t = F.lower("_t") if lower else F.col("_t")
    rows = rows.select(key, "_t", (strip_accents(t) if accents else t).alias("_x"))
    words = rows.select(key, F.xxhash64("_t").alias("_h"), F.explode(F.regexp_extract_all("_x", F.lit(r"(\b\w\w+\b)"), F.lit(1))).alias("word"))
    counts = words.groupBy(key, "_h", "word").agg(F.count("*").alias("c"))
    if stop_words:
        counts = counts.where(~F.col("word").isin(list(stop_words)))
    if vocabulary is not None:
        counts = counts.join(vocabulary.select(F.col(vocabulary.columns[0]).alias("word")).distinct(), "word", "left_semi")
    if least > 1:
        counts = counts.join(counts.groupBy("word").agg(F.count("*").alias("_d")).where(F.col("_d") >= least).select("word"), "word", "left_semi")
    a = counts.select(key, "_h", F.col("word").alias("src"), F.col("c").alias("_a"))
    b = counts.select(key, "_h", F.col("word").alias("dst"), F.col("c").alias("_b"))
    return a.join(b, [key, "_h"]).where("src <= dst").groupBy("src", "dst").agg(F.sum(F.col("_a") * F.col("_b")).alias("weight"))
