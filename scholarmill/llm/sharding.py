"""Extendible hashing: shards of bounded size, found by hash-prefix bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scholarmill.session import cut_lineage

#: Hash bits that a directory may use.
MAX_DEPTH = 60
#: Levels looked at in one pass over the bucket sizes.
STEP = 8
#: Leaf tables of at most so many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 200_000


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text as a long; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(bits: Column, depth: int | Column) -> Column:
    """The first `depth` of the 60 hash bits."""
    return F.call_function("shiftright", bits, (F.lit(MAX_DEPTH) - depth).cast("int"))


def _n_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def directory(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Leaf buckets (depth, prefix, n_docs, n_bytes) of the directory for shards of at most max_bytes.

    A bucket that is too large splits on its next hash bit, others stay whole,
    so depth follows the local load. The sizes are added up once over prefixes
    fine enough for the mean load, and refined eight bits at a time only under
    buckets that are still too large; nothing but two numbers comes to the
    driver. A bucket of a single hash value can't be split and may exceed the
    limit. An empty table has one empty bucket of depth 0.
    """
    rows = cut_lineage(docs.select(hash_bits(F.col(key)).alias("bits"), _n_bytes(text).alias("n_bytes")).groupBy("bits").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    depth = min(MAX_DEPTH, STEP + math.ceil(math.log2(max(1.0, total[0] / max_bytes))))
    if not total[1]:
        return docs.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("n_docs"), F.lit(0).cast("bigint").alias("n_bytes"))
    low, leaves, live, over = 0, None, rows, None
    while True:
        cells = cut_lineage(live.groupBy(prefix(F.col("bits"), depth).alias("cell")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_keys")))
        levels = (
            cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"))
            .groupBy("depth", F.call_function("shiftright", "cell", (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"))
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_keys").alias("n_keys"))
        )
        fits = (F.col("n_bytes") <= max_bytes) | (F.col("n_keys") == 1) | (F.col("depth") == MAX_DEPTH)
        levels = levels.withColumn("fits", fits)
        inner = levels.where(~F.col("fits") & (F.col("depth") < depth)).select((F.col("depth") + 1).alias("depth"), "prefix")
        born = inner.select("depth", F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        if over is None:
            born = born.union(docs.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix")))
        else:
            born = born.union(over.select("depth", "prefix"))
        leaf = levels.join(born, ["depth", "prefix"], "left_semi").where("fits").select("depth", "prefix", "n_docs", "n_bytes")
        leaves = leaf if leaves is None else leaves.union(leaf)
        deepest = levels.where(~F.col("fits") & (F.col("depth") == depth)).select("prefix")
        if depth == MAX_DEPTH or deepest.isEmpty():
            return cut_lineage(leaves)
        nxt = min(MAX_DEPTH, depth + STEP)
        over = cut_lineage(deepest.select(F.lit(depth + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")))
        live = live.join(deepest.withColumnRenamed("prefix", "_p"), prefix(F.col("bits"), depth) == F.col("_p"), "left_semi")
        low, depth = depth + 1, nxt


def shard_name(depth: Column, first_bits: Column) -> Column:
    """The bits of a leaf as text, the empty string for the whole directory; names sort by hash."""
    return F.when(depth == 0, F.lit("")).otherwise(F.call_function("lpad", F.bin(first_bits), depth.cast("int"), F.lit("0")))


def shard(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard_depth, shard_id) for each row of docs.

    shard_id is the hash prefix of the shard, a string of shard_depth bits, so
    no task numbers the shards. The size of a row is the UTF-8 bytes of its
    text, 0 for a null or an empty one. Rows of one key, also repeated rows and
    all rows of a null key, share a shard; a row above the limit has a shard of
    its own. Other columns of docs play no part. An empty table gives an empty
    result.
    """
    leaves = directory(docs, max_bytes, key, text).select("depth", "prefix")
    facts = leaves.agg(F.count("*"), F.collect_set("depth")).first()
    depths = sorted(facts[1])
    rows = docs.select(F.col(key), _n_bytes(text).alias("n_bytes"), hash_bits(F.col(key)).alias("_bits"))
    # A row meets one leaf among the depths in use, of which there are few.
    tries = rows.withColumn("_try", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), prefix(F.col("_bits"), d).alias("p")) for d in depths])))
    side = F.broadcast(leaves) if facts[0] <= BROADCAST_ROWS else leaves
    found = tries.join(side, (F.col("_try.d") == F.col("depth")) & (F.col("_try.p") == F.col("prefix")))
    return found.select(key, "n_bytes", F.col("depth").alias("shard_depth"), shard_name(F.col("depth"), F.col("prefix")).alias("shard_id"))


def write_shards(docs: DataFrame, path: str, max_bytes: int, key: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet with one directory a shard, shard_id=N; the whole directory is named `all`.

    docs must have no columns shard_id and _shard_bits.
    """
    ids = shard(docs.select(key, text), max_bytes, key, text).select(hash_bits(F.col(key)).alias("_shard_bits"), F.when(F.col("shard_depth") == 0, F.lit("all")).otherwise(F.concat(F.lit("b"), "shard_id")).alias("shard_id")).distinct()
    docs.withColumn("_shard_bits", hash_bits(F.col(key))).join(ids, "_shard_bits").drop("_shard_bits").repartition("shard_id").write.partitionBy("shard_id").parquet(path)
