"""Fields to project on: numeric pairs, time-value pairs, and their domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import micros, widen_domain
from ..functions.cells import finite, invalid_number, missing, numeric

MODES = ("density", "composition", "comparison", "ridges")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampNTZType, T.TimestampType)
_CATEGORIES = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


@dataclass(frozen=True)
class Mapping:
    """What a view binds: x and y (for ``kind`` 'pair'), or time and value (for 'time'), and optionally a category."""

    x: str
    y: str
    kind: str = "pair"
    category: str | None = None

    def validate(self, schema: T.StructType) -> None:
        """Columns exist, differ, and have kinds their roles accept."""
        names = [self.x, self.y, *([self.category] if self.category else [])]
        known = {f.name: f.dataType for f in schema}
        for n in names:
            if n not in known:
                raise ValueError(f"column {n!r} does not exist")
        if len(set(names)) < len(names):
            raise ValueError("a mapping needs distinct columns")
        if self.kind not in ("pair", "time"):
            raise ValueError(f"unknown mapping {self.kind!r}")
        first = _TIMES if self.kind == "time" else _NUMBERS
        if not isinstance(known[self.x], first) or not isinstance(known[self.y], _NUMBERS):
            raise ValueError(f"columns {self.x!r} and {self.y!r} do not suit a {self.kind} mapping")
        if self.category and not isinstance(known[self.category], _CATEGORIES):
            raise ValueError(f"column {self.category!r} cannot be a category")

    def supports(self, mode: str) -> bool:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        return mode != "composition" or self.category is not None


def mean_difference(df: DataFrame, x: str, y: str, mean: str = "mean", difference: str = "difference") -> DataFrame:
    """Add (x + y) / 2 and x - y, worked out in doubles and narrowed to 32-bit floats."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.withColumn(mean, ((a + b) / 2).cast("float")).withColumn(difference, (a - b).cast("float"))


def project(df: DataFrame, mapping: Mapping, on_bad: str = "drop") -> DataFrame:
    """Add doubles ``px`` and ``py`` (and exact ``px_us`` for times); rows without both are dropped, or an error.

    ``on_bad`` 'reject' raises, naming how many rows are missing or invalid.
    """
    mapping.validate(df.schema)
    kinds = {f.name: f.dataType for f in df.schema}
    if mapping.kind == "time":
        out = df.withColumn("px_us", micros(F.col(mapping.x))).withColumn("px", F.col("px_us").cast("double"))
    else:
        out = df.withColumn("px", numeric(F.col(mapping.x), kinds[mapping.x]))
    out = out.withColumn("py", numeric(F.col(mapping.y), kinds[mapping.y]))
    bad = F.col("px").isNull() | F.col("py").isNull()
    if on_bad == "reject":
        n = out.where(bad).count()
        if n:
            raise ValueError(f"{n} rows have no value in {mapping.x!r} or {mapping.y!r}")
        return out
    return out.where(~bad)


@dataclass(frozen=True)
class Extent:
    x0: float
    x1: float
    y0: float
    y1: float
    rows: int

    def widened(self) -> Extent:
        """With single values turned into domains."""
        return Extent(*widen_domain(self.x0, self.x1), *widen_domain(self.y0, self.y1), self.rows)


def extent(projected: DataFrame, x: str = "px", y: str = "py") -> Extent:
    """Exact bounds of both axes in one aggregate; no valid row is an error."""
    a, b = finite(F.col(x).cast("double")), finite(F.col(y).cast("double"))
    r = projected.agg(F.min(a), F.max(a), F.min(b), F.max(b), F.count(F.when(a.isNotNull() & b.isNotNull(), 1))).first()
    if not r[4]:
        raise ValueError("no row has a value on both axes")
    return Extent(*r)


def bad_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the counts of missing and of invalid numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = []
    for c in columns:
        aggs += [F.count_if(missing(F.col(c), kinds[c])).alias(f"{c}_missing"), F.count_if(invalid_number(F.col(c), kinds[c])).alias(f"{c}_invalid")]
    return df.agg(*aggs)
