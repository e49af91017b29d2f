"""Filters on publications, as predicates and semi-joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


class RangeFilter:
    """low <= field <= high; either bound may be left out, not both. Nulls don't pass."""

    def __init__(self, field: str, low=None, high=None):
        if low is None and high is None:
            raise ValueError("a range needs a bound")
        self.field, self.low, self.high = field, low, high

    def condition(self) -> Column:
        c = F.col(self.field)
        if self.low is None:
            return c <= F.lit(self.high)
        if self.high is None:
            return c >= F.lit(self.low)
        return c.between(self.low, self.high)


class SetFilter:
    """field is one of the values. Nulls don't pass; no values, no rows."""

    def __init__(self, field: str, values: Iterable):
        self.field, self.values = field, sorted(set(values))

    def condition(self) -> Column:
        return F.col(self.field).isin(self.values) if self.values else F.lit(False)


class YearFilter(RangeFilter):
    def __init__(self, low: int | None = None, high: int | None = None):
        super().__init__("Year", low, high)


class DocTypeFilter(SetFilter):
    def __init__(self, values: Iterable):
        super().__init__("DocType", values)


class FieldFilter(SetFilter):
    def __init__(self, values: Iterable):
        super().__init__("FieldId", values)


class JournalFilter(SetFilter):
    def __init__(self, values: Iterable):
        super().__init__("JournalId", values)


def in_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str | None = None, negate: bool = False) -> DataFrame:
    """Rows whose column is among ids, in any order and with repeats; with negate, the other ones, nulls too."""
    ids = ids.select(F.col(id_column or ids.columns[0]).alias("_id")).distinct()
    return df.join(ids, F.col(column) == F.col("_id"), "left_anti" if negate else "left_semi")


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def publication_ids(filters, pub: DataFrame, pub2field: DataFrame | None = None) -> DataFrame:
    """The ids that pass all filters on Year, DocType and FieldId; the last filter of a field counts, any other field is a TypeError.

    A publication passes a field filter if one of its fields is in the set.
    """
    filters = list(filters.values()) if isinstance(filters, dict) else list(filters) if isinstance(filters, (list, tuple)) else [filters]
    by_field = {f.field: f for f in filters}
    if other := set(by_field) - {"Year", "DocType", "FieldId"}:
        raise TypeError(f"no global filter on {sorted(other)}")
    ids = pub
    for name in ("Year", "DocType"):
        if name in by_field:
            ids = ids.where(by_field[name].condition())
    ids = ids.select("PublicationId").where("PublicationId IS NOT NULL").distinct()
    if "FieldId" in by_field:
        ids = in_ids(ids, "PublicationId", pub2field.where(by_field["FieldId"].condition()), "PublicationId")
    return ids


def filter_references(pub2ref: DataFrame, ids: DataFrame) -> DataFrame:
    """References of which both ends are among ids."""
    return in_ids(in_ids(pub2ref, "CitingPublicationId", ids), "CitedPublicationId", ids)
