"""Typed cells: a value that is present, missing (blank) or invalid (does not parse)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE, MISSING, INVALID = "value", "missing", "invalid"

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends; ``trim`` strips only U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or only white space; never null itself."""
    return F.coalesce(trim_ws(c.cast("string")) == "", F.lit(True))


def finite(c: Column) -> Column:
    """The double, or null where it is null, NaN or infinite.  NaN sorts above everything in Spark, so this comes first."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def parse_float(c: Column) -> Column:
    """A finite double from trimmed text; null for blank or malformed text and for values beyond the range."""
    t = trim_ws(c)
    return finite(F.when(t.rlike(_FLOAT), t.try_cast("double")))


def parse_integer(c: Column) -> Column:
    """A decimal(20,0) from trimmed text in the range of signed or unsigned 64-bit integers, else null."""
    t = trim_ws(c)
    v = F.when(t.rlike(_INTEGER), t.try_cast("decimal(38,0)"))
    return F.when((v >= F.lit(-(2**63))) & (v <= F.expr("18446744073709551615BD")), v.cast("decimal(20,0)"))


def numeric(c: Column, kind: T.DataType) -> Column:
    """A finite double from a column of ``kind``.  Typed columns are not wrapped in text functions, so filters on them reach the scan."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if isinstance(kind, _NUMERIC):
        return c.cast("double")
    return parse_float(c.cast("string"))


def missing(c: Column, kind: T.DataType) -> Column:
    """Whether a cell is missing: null, or blank text."""
    return is_blank(c) if isinstance(kind, T.StringType) else c.isNull()


def invalid_number(c: Column, kind: T.DataType) -> Column:
    """Present, but not a finite number."""
    return ~missing(c, kind) & numeric(c, kind).isNull()


def cell(c: Column, value: Column, kind: T.DataType) -> Column:
    """struct(raw, value, state): the raw spelling, the typed value or null, and which of the three states holds."""
    blank = missing(c, kind)
    state = F.when(blank, MISSING).when(value.isNull(), INVALID).otherwise(VALUE)
    return F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("raw"), F.when(~blank, value).alias("value"), state.alias("state"))
