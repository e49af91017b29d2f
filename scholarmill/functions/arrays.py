"""Scalar and array functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def kl(p: Column, q: Column, mode: str = "paper") -> Column:
    """Kullback-Leibler divergence in bits of arrays of chances; terms with p = 0 are 0, infinite where only q is 0. Mode "reference" has the sign turned."""
    term = lambda x, y: F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(float("inf"))).otherwise(x * F.log2(x / F.nullif(y, F.lit(0.0))))
    value = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return value if mode == "paper" else -value


def jensen_shannon(p: Column, q: Column, mode: str = "paper") -> Column:
    """The mean of the divergences from the middle."""
    middle = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, middle, mode) + kl(q, middle, mode)) / 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def sparse_cosine(a: DataFrame, b: DataFrame, by: list[str], key: str, value: str, distance: bool = False) -> DataFrame:
    """(by, Cosine) of two tables of sparse vectors, one vector for each by; pairs of vectors without a common key have 0."""
    a, b = (df.withColumn(value, F.col(value).cast("double")) for df in (a, b))  # products of whole numbers may not fit
    size = lambda df, n: df.groupBy(*by).agg(F.sum(F.col(value) * F.col(value)).alias(n))
    both = a.select(*by, key, F.col(value).alias("_a")).join(b.select(*by, key, F.col(value).alias("_b")), [*by, key]).groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("_d"))
    out = size(a, "_qa").join(size(b, "_qb"), by).join(both, by, "left")
    c = F.coalesce(F.try_divide("_d", F.sqrt(F.col("_qa") * F.col("_qb"))), F.lit(0.0))
    return out.select(*by, (1 - c if distance else c).alias("Cosine"))


def human_size(n: Column) -> Column:
    """Bytes as text, 1024 to the next unit, two digits at most: 0B, 1.5 KB."""
    out = F.when(n == 0, F.lit("0B"))
    units = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
    for i, u in enumerate(units):
        value = F.round(n / F.lit(1024.0**i), 2).cast("string")
        out = out.when(n < 1024 ** (i + 1), F.concat(value, F.lit(f" {u}"))) if i < len(units) - 1 else out.otherwise(F.concat(value, F.lit(f" {u}")))
    return out


def sem_axis(vectors: DataFrame, positive: DataFrame, negative: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, SemAxis): cosine of each vector with the mean of the positive ones less that of the negative ones. Both lists are tables of keys."""

    def mean(ids: DataFrame, name: str) -> DataFrame:
        mine = vectors.join(ids.select(key).distinct(), key, "left_semi")
        flat = mine.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias(name))

    axis = mean(positive, "_p").crossJoin(mean(negative, "_n")).select(F.zip_with("_p", "_n", lambda x, y: x - y).alias("_axis"))
    return vectors.crossJoin(F.broadcast(axis)).select(key, cosine(F.col(vector), F.col("_axis")).alias("SemAxis"))
