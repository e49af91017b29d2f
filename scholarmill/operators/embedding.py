"""Vertex embeddings from random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholarmill.session import cut_lineage

#: Steps between two cuts of the lineage.
CUT_EVERY = 10


def random_walks(edges: DataFrame, walks: int = 10, length: int = 80, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """(start, walk, path): weighted walks over directed edges (src, dst, weight) from every vertex, ended early at a vertex without a way out.

    A step is drawn by a hash of walk and step, so that repeated tasks draw
    the same. p and q weigh going back and going farther away, as in node2vec.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w"))
    out = cut_lineage(edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("ways")))
    vertices = edges.select(F.col("src").alias("start")).union(edges.select("dst")).distinct()
    live = vertices.select("start", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.array("start").alias("path"), F.lit(False).alias("ended"))
    near = out.select(F.col("src").alias("_prev"), F.transform("ways", lambda x: x["dst"]).alias("_near"))
    for step in range(1, length):
        x = live.withColumn("_at", F.element_at("path", -1)).join(out.withColumnRenamed("src", "_at"), "_at", "left")
        if (p, q) != (1.0, 1.0) and step > 1:
            x = x.withColumn("_prev", F.get("path", F.size("path") - 2)).join(near, "_prev", "left")
            x = x.withColumn("ways", F.transform("ways", lambda v: F.struct(v["dst"].alias("dst"), (v["w"] * F.when(v["dst"] == F.col("_prev"), 1 / p).when(F.array_contains("_near", v["dst"]), 1.0).otherwise(1 / q)).alias("w"))))
        total = F.aggregate("ways", F.lit(0.0), lambda s, v: s + v["w"])
        draw = (F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step)), F.lit(1 << 40)) / F.lit(float(1 << 40))) * total
        init = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("v"))
        chosen = F.aggregate("ways", init, lambda s, v: F.struct((s["s"] + v["w"]).alias("s"), F.when(s["v"].isNull() & (s["s"] + v["w"] > draw), v["dst"]).otherwise(s["v"]).alias("v")))["v"]
        go = ~F.col("ended") & chosen.isNotNull()
        live = x.select("start", "walk", F.when(go, F.concat("path", F.array(chosen))).otherwise(F.col("path")).alias("path"), (~go).alias("ended"))
        if step % CUT_EVERY == 0:
            live = cut_lineage(live)
            if live.where("NOT ended").isEmpty():
                break
    return live.select("start", "walk", "path")


def node2vec(edges: DataFrame, walks: int = 10, length: int = 80, p: float = 1.0, q: float = 1.0, dimensions: int = 128, window: int = 10, epochs: int = 1, seed: int = 1) -> DataFrame:
    """(vertex, embedding): skip-gram vectors of vertices (as text) from random walks."""
    from pyspark.ml.feature import Word2Vec

    paths = cut_lineage(random_walks(edges, walks, length, p, q, seed).select(F.transform("path", lambda v: v.cast("string")).alias("path")))
    model = Word2Vec(vectorSize=dimensions, windowSize=window, minCount=0, maxIter=epochs, seed=seed, inputCol="path", outputCol="v").fit(paths)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("vertex"), vector_to_array("vector", "float32").alias("embedding"))
