"""A named set of tables, loaded lazily with projections, id filters and dedup."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scholarmill.operators import aggregates, filters, impact
from scholarmill.schema import SCHEMAS, require_columns


def dedup(df: DataFrame, subset: list[str], keep: str, order: list[str]) -> DataFrame:
    """One row of each subset, the first or last by order; of rows equal in order, any."""
    w = Window.partitionBy(*subset).orderBy(*[F.desc(c) if keep == "last" else F.asc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Catalog:
    """Tables under a folder, one directory or file each, as Parquet, CSV or JSON; tables can also be given as DataFrames."""

    def __init__(self, spark: SparkSession, path: str | None = None, extension: str = "parquet", keep_in_memory: bool = False, global_filter=None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.path, self.extension, self.keep_in_memory = spark, path, extension, keep_in_memory
        self._paths: dict[str, str] = {}
        self._tables = dict(tables or {})
        self._ids: DataFrame | None = None
        if global_filter is not None:
            self.set_global_filters(global_filter)

    def set_data_path(self, name: str, path: str) -> None:
        self._paths[name] = path
        self._tables.pop(name, None)

    def _read(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        where = self._paths.get(name) or (self.path and os.path.join(self.path, name))
        if not where:
            raise FileNotFoundError(name)
        if self.extension == "parquet":
            return self.spark.read.parquet(where)
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        if self.extension.startswith("csv"):
            return reader.option("header", True).option("escape", "\\").csv(where)
        if self.extension.startswith("json"):
            return reader.json(where)
        raise ValueError(f"no reader for {self.extension}; convert it to Parquet first")

    def load(self, name: str, columns: list[str] | None = None, filters_: dict[str, DataFrame] | None = None, dropna: list[str] | None = None, duplicate_subset: list[str] | None = None, duplicate_keep: str = "last", duplicate_order: list[str] | None = None, source_file: bool = False, before=None, after=None) -> DataFrame:
        """A table: before(df), columns, rows without nulls in dropna, id filters (column: table of ids), global filter, dedup, after(df)."""
        df = self._read(name)
        if source_file:
            df = df.withColumn("filetag", F.col("_metadata.file_name"))
        if before is not None:
            df = df.transform(before)
        if columns is not None:
            df = require_columns(df, *columns).select(*columns, *(["filetag"] if source_file else []))
        if dropna:
            df = df.dropna(subset=dropna)
        for column, ids in (filters_ or {}).items():
            df = filters.in_ids(df, column, ids)
        if self._ids is not None:
            for column in ("PublicationId", "CitingPublicationId", "CitedPublicationId"):
                if column in df.columns and name not in ("affiliation", "author", "journal", "fieldinfo"):
                    df = filters.in_ids(df, column, self._ids)
        if duplicate_subset:
            df = dedup(df, duplicate_subset, duplicate_keep, duplicate_order or [c for c in df.columns if c not in duplicate_subset] or duplicate_subset)
        if after is not None:
            df = df.transform(after)
        return df

    def _property(self, name: str) -> DataFrame:
        if not self.keep_in_memory:
            return self.load(name)
        if name not in self._tables:
            self._tables[name] = self._read(name).persist()
        return self.load(name)

    pub = property(lambda self: self._property("publication"))
    author = property(lambda self: self._property("author"))
    affiliation = property(lambda self: self._property("affiliation"))
    journal = property(lambda self: self._property("journal"))
    pub2ref = property(lambda self: self._property("pub2ref"))
    pub2refnoself = property(lambda self: self._property("pub2refnoself"))
    paa = property(lambda self: self._property("publicationauthoraffiliation"))
    pub2field = property(lambda self: self._property("pub2field"))
    fieldinfo = property(lambda self: self._property("fieldinfo"))

    @property
    def author2pub(self) -> DataFrame:
        return self.paa.select("AuthorId", "PublicationId").dropna().distinct()

    @property
    def pub2year(self) -> DataFrame:
        return self.pub.select("PublicationId", "Year").dropna()

    @property
    def pub2doctype(self) -> DataFrame:
        return self.pub.select("PublicationId", "DocType").dropna()

    def set_global_filters(self, filters_) -> None:
        pub = self._read("publication")
        wanted = filters_.values() if isinstance(filters_, dict) else filters_ if isinstance(filters_, (list, tuple)) else [filters_]
        needs_field = any(f.field == "FieldId" for f in wanted)
        self._ids = filters.publication_ids(filters_, pub, self._read("pub2field") if needs_field else None)

    def publication_ids(self) -> DataFrame:
        """Distinct ids in order: of the global filter, or of all publications."""
        ids = self._ids if self._ids is not None else self.pub.select("PublicationId").dropna().distinct()
        return ids.orderBy("PublicationId")

    def publication_info(self, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.load("publication", columns, {"PublicationId": ids})

    def author_publications(self, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
        rows = filters.in_ids(self.paa, "AuthorId", ids)
        return rows.join(self.pub.select("PublicationId", *[c for c in columns or ["Year"] if c not in rows.columns]), "PublicationId", "left")

    def journal_publications(self, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.load("publication", columns, {"JournalId": ids})

    def impact(self, horizons: tuple[int, ...] = (5, 10), noself: bool = True) -> DataFrame:
        return impact.compute_impact(self.pub2ref, self.pub, self.author2pub if noself else None, horizons)

    def team_size(self) -> DataFrame:
        return aggregates.team_size(self.paa)

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, rows_a_file: int = 10_000_000) -> None:
        """Write a table of the catalog, in its format, files of bounded length."""
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        where = self._paths.get(name) or os.path.join(self.path, name)
        if self.extension.startswith("csv"):
            writer = writer.option("header", True).option("escape", "\\")
            if self.extension.endswith("gz"):
                writer = writer.option("compression", "gzip")
            writer.csv(where)
        elif self.extension.startswith("json"):
            writer.json(where)
        else:
            writer.parquet(where)

    def append_columns(self, new: DataFrame, name: str, to: str) -> None:
        """Write a table with the columns of new, joined on all columns that both have, under another name."""
        df = self._read(name)
        self.save(df.join(new, [c for c in df.columns if c in new.columns], "left"), to)
