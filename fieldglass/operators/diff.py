"""Two versions of a table: their columns and their missing cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import missing


def kind_name(kind: T.DataType) -> str:
    """Integer, Float, String, Empty, or the type's own name."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "Float"
    return {T.StringType: "String", T.NullType: "Empty", T.BooleanType: "Boolean", T.TimestampNTZType: "Timestamp", T.TimestampType: "Timestamp"}.get(type(kind), "Unsupported")


def diff_by_ordinal(before: T.StructType, after: T.StructType) -> list[tuple[int, str | None, str | None, str]]:
    """(ordinal, name before, name after, status) position by position; names that occur twice on a side are ambiguous."""
    twice = {n for s in (before, after) for n in s.names if s.names.count(n) > 1}
    out = []
    for i, (a, b) in enumerate(zip_longest(before, after)):
        if (a and a.name in twice) or (b and b.name in twice):
            status = "ambiguous"
        elif a is None or b is None:
            status = "added" if a is None else "removed"
        elif a.name != b.name:
            status = "renamed"
        else:
            status = "unchanged" if a.dataType == b.dataType else "type_changed"
        out.append((i, a.name if a else None, b.name if b else None, status))
    return out


def _missing(df: DataFrame) -> DataFrame:
    """(column, kind, missing, rows): one wide aggregate."""
    aggs = [F.count(F.lit(1)).alias("all")] + [F.count_if(missing(F.col(f.name), f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema)]
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(kind_name(f.dataType)).alias("kind"), F.col(f"m{i}").alias("missing"), F.col("all").alias("rows")) for i, f in enumerate(df.schema)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def diff_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before_kind, after_kind, status) by name, from the schemas alone."""
    kinds = [{f.name: kind_name(f.dataType) for f in df.schema} for df in (before, after)]
    rows = []
    for n in sorted(kinds[0].keys() | kinds[1].keys()):
        a, b = kinds[0].get(n), kinds[1].get(n)
        rows.append((n, a, b, "added" if a is None else "removed" if b is None else "unchanged" if a == b else "type_changed"))
    return before.sparkSession.createDataFrame(rows, "column string, before_kind string, after_kind string, status string")


def diff_missingness(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, counts, ratios, deltas, row_delta) of the columns both have; ratio deltas in percentage points."""
    a = _missing(before).select("column", F.col("missing").alias("before_missing"), F.col("rows").alias("before_rows"))
    b = _missing(after).select("column", F.col("missing").alias("after_missing"), F.col("rows").alias("after_rows"))
    ratio = lambda m, n: F.when(F.col(n) > 0, F.col(m) / F.col(n)).otherwise(0.0)
    both = a.join(F.broadcast(b), "column")  # one row for each column
    return both.select(
        "column", "before_missing", "after_missing", (F.col("after_missing") - F.col("before_missing")).alias("missing_delta"),
        ((ratio("after_missing", "after_rows") - ratio("before_missing", "before_rows")) * 100).alias("ratio_delta_pp"), (F.col("after_rows") - F.col("before_rows")).alias("row_delta"),
    )


def shared(before: DataFrame, after: DataFrame) -> Sequence[str]:
    return [c for c in before.columns if c in after.columns]
