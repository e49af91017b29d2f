"""Citation counts over new works as they arrive: an extension, batch results are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_works(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of (CitingPublicationId, CitedPublicationId, Updated) under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def citation_counts(references: DataFrame, time: str = "Updated", late: str = "30 days") -> DataFrame:
    """Citations of each publication so far (update mode); a reference that is seen again within `late` counts once."""
    once = references.withWatermark(time, late).dropDuplicatesWithinWatermark(["CitingPublicationId", "CitedPublicationId"])
    return once.groupBy("CitedPublicationId").agg(F.count("*").alias("Citations"))


def windowed_counts(references: DataFrame, time: str = "Updated", window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Citations by window of time (append mode), once no more can come in."""
    return references.withWatermark(time, late).groupBy(F.window(time, window), "CitedPublicationId").agg(F.count("*").alias("Citations"))
