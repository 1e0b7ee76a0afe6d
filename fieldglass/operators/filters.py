"""Filters joined by AND, and the cohorts they make."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import invalid_number, missing, numeric, trim_ws


@dataclass(frozen=True)
class NumericRange:
    """lo <= value <= hi.  Missing and invalid cells follow ``include_missing``."""

    column: str
    lo: float
    hi: float
    include_missing: bool = False

    def __post_init__(self) -> None:
        if not (float("-inf") < self.lo <= self.hi < float("inf")):
            raise ValueError(f"filter on {self.column!r} needs finite, ordered bounds")

    def condition(self, kind: T.DataType) -> Column:
        v = numeric(F.col(self.column), kind)
        inside = v.between(self.lo, self.hi)
        return F.coalesce(inside, F.lit(True)) if self.include_missing else F.coalesce(inside, F.lit(False))

    @property
    def is_numeric(self) -> bool:
        return True


@dataclass(frozen=True)
class CategorySet:
    """Trimmed text is one of ``values``; no values match nothing but, if included, the missing."""

    column: str
    values: tuple[str, ...]
    include_missing: bool = False

    def condition(self, kind: T.DataType) -> Column:
        text = F.col(self.column)
        values = sorted(set(self.values))
        if isinstance(kind, T.StringType):
            text = trim_ws(text)
        else:
            text = text.cast("string")
        hit = text.isin(values) if values else F.lit(False)
        blank = missing(F.col(self.column), kind)
        return F.when(blank, F.lit(self.include_missing)).otherwise(F.coalesce(hit, F.lit(False)))

    @property
    def is_numeric(self) -> bool:
        return False


Filter = NumericRange | CategorySet


@dataclass(frozen=True)
class FilterSet:
    """At most one filter a column; the revision grows only when the set changes."""

    filters: tuple[Filter, ...] = ()
    revision: int = 0

    def put(self, f: Filter) -> FilterSet:
        if f in self.filters:
            return self
        kept = [g for g in self.filters if g.column != f.column]
        return FilterSet((*kept, f), self.revision + 1)

    def remove(self, column: str) -> FilterSet:
        kept = tuple(g for g in self.filters if g.column != column)
        return self if len(kept) == len(self.filters) else FilterSet(kept, self.revision + 1)

    def clear(self) -> FilterSet:
        return FilterSet((), self.revision + 1) if self.filters else self

    def with_missing(self, include: bool) -> FilterSet:
        return FilterSet(tuple(replace(f, include_missing=include) for f in self.filters), self.revision)

    def condition(self, schema: T.StructType) -> Column:
        kinds = {f.name: f.dataType for f in schema}
        for f in self.filters:
            if f.column not in kinds:
                raise ValueError(f"filter names unknown column {f.column!r}")
        return reduce(lambda a, b: a & b, (f.condition(kinds[f.column]) for f in self.filters), F.lit(True))


@dataclass(frozen=True)
class Cohort:
    """Filters with one policy for missing cells: 'exclude', 'include' or 'reject' (invalid numbers are an error)."""

    filters: FilterSet = field(default_factory=FilterSet)
    policy: str = "exclude"

    def __post_init__(self) -> None:
        if self.policy not in ("exclude", "include", "reject"):
            raise ValueError(f"unknown policy {self.policy!r}")

    def apply(self, df: DataFrame, out: str = "included") -> DataFrame:
        """Add the membership column."""
        if self.policy == "reject":
            self._reject(df)
        return df.withColumn(out, self.filters.with_missing(self.policy == "include").condition(df.schema))

    def _reject(self, df: DataFrame) -> None:
        kinds = {f.name: f.dataType for f in df.schema}
        for f in self.filters.filters:
            if f.is_numeric:
                n = df.where(invalid_number(F.col(f.column), kinds[f.column])).count()
                if n:
                    raise ValueError(f"column {f.column!r} has {n} invalid values")

    def stats(self, df: DataFrame) -> DataFrame:
        """One row: total, included, and excluded rows with a missing and with an invalid filtered cell; a row may count in both."""
        marked = self.apply(df, "_included")
        kinds = {f.name: f.dataType for f in df.schema}
        any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
        gone = any_of(missing(F.col(f.column), kinds[f.column]) for f in self.filters.filters)
        bad = any_of(invalid_number(F.col(f.column), kinds[f.column]) for f in self.filters.filters if f.is_numeric)
        return marked.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if("_included").alias("included_rows"),
            F.count_if(~F.col("_included") & gone).alias("excluded_missing"),
            F.count_if(~F.col("_included") & bad).alias("excluded_invalid"),
        )


def first_invalid(df: DataFrame, filters: FilterSet, row_id: str) -> DataFrame:
    """The first invalid number of the numeric-filtered columns, by column order and then row: (column, row_id), or no row."""
    kinds = {f.name: f.dataType for f in df.schema}
    order = [c for c in df.columns if any(f.column == c and f.is_numeric for f in filters.filters)]
    if not order:
        return df.sparkSession.createDataFrame([], "column string, row_id long")
    aggs = [F.min(F.when(invalid_number(F.col(c), kinds[c]), F.col(row_id))).alias(f"r{i}") for i, c in enumerate(order)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").cast("long").alias("row_id")) for i, c in enumerate(order)])
    return one.select(F.inline(F.slice(F.filter(rows, lambda r: r["row_id"].isNotNull()), 1, 1)))


def in_box(x: Column, y: Column, box: Sequence[float]) -> Column:
    """Inside (x0, x1, y0, y1), edges included; NaN and null are outside."""
    inside = x.between(box[0], box[1]) & y.between(box[2], box[3])
    return F.coalesce(inside, F.lit(False))


def in_time_brush(ts: Column, lane: Column, time: tuple[int, int], lanes: tuple[int, int]) -> Column:
    """Time inclusive at both ends, lanes half-open."""
    return F.coalesce(ts.between(*time) & (lane >= lanes[0]) & (lane < lanes[1]), F.lit(False))
