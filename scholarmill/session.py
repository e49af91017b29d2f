"""Sessions and cut lineage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass its own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scholarmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of our own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.getCheckpointDir():
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='scholarmill-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    One job, columnar and compressed; a lost executor costs no recomputation
    of what is behind it, so its shuffle files are removed as soon as the table
    is written. The tables live as long as the shared folder.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scholarmill/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the largest input table for each part of spread().
PART_BYTES = 2 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df parted by the keys, into more parts the larger its largest input table is, so that a task's share doesn't grow with it.

    What is grouped by the keys, or more columns, needs no other shuffle, and
    no map of all its groups is kept by the tasks that read.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = max((x for x in sizes if x < 1 << 60), default=0)  # rows of the driver have no size
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / PART_BYTES)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
