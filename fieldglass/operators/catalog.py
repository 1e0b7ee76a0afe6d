"""What a table's columns hold: numeric summaries, top values, profiles, missingness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import invalid_number, missing, numeric, trim_ws

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def numeric_catalog(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, valid, missing, invalid): all columns in one wide aggregate, then turned to rows."""
    kinds = _kinds(df)
    columns = list(columns or [c for c, k in kinds.items() if isinstance(k, _NUMBERS)])
    aggs = []
    for i, c in enumerate(columns):
        v = numeric(F.col(c), kinds[c])
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.count(v).alias(f"c{i}"), F.count_if(missing(F.col(c), kinds[c])).alias(f"d{i}"), F.count_if(invalid_number(F.col(c), kinds[c])).alias(f"e{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"a{i}").cast("double").alias("min"), F.col(f"b{i}").cast("double").alias("max"), F.col(f"c{i}").alias("valid"), F.col(f"d{i}").alias("missing"), F.col(f"e{i}").alias("invalid")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, first_row?) of present values: one expand, one shuffle of partial counts."""
    kinds = _kinds(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(F.col(c), kinds[c]).alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _text(c: Column, kind: T.DataType) -> Column:
    t = trim_ws(c) if isinstance(kind, T.StringType) else c.cast("string")
    return F.when(~missing(c, kind), t)


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of each column, ties by value.

    Ranks are taken in slices of a column's values first, so a column with
    very many distinct values does not meet in one task.
    """
    counts = value_counts(df, columns).withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.desc("n"), F.col("value")]
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("column", "slice").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("column", "rank", "value", "n")


def categorical_catalog(df: DataFrame, columns: Sequence[str], budget: int = 4096) -> DataFrame:
    """(column, distinct, valid, missing, truncated): exact distinct counts; truncated when over the budget."""
    kinds = _kinds(df)
    valued = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("valid"))
    gaps = df.agg(*[F.count_if(missing(F.col(c), kinds[c])).alias(f"m{i}") for i, c in enumerate(columns)])
    missing_rows = gaps.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])))
    joined = missing_rows.join(valued, "column", "left")
    return joined.select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce("valid", F.lit(0)).alias("valid"), "missing", (F.coalesce("distinct", F.lit(0)) > budget).alias("truncated"))


def column_profile(df: DataFrame, column: str, row_id: str, budget: int = 256, leaders: int = 8) -> DataFrame:
    """One row: valid, missing, invalid, distinct, accuracy and leaders.

    Up to ``budget`` distinct values the count is exact.  Beyond, the profile
    keeps the values seen first (by row id), reports budget + 1 as 'at_least',
    and takes leaders from those it kept.  Leaders go by count, ties by value.
    """
    kind = _kinds(df)[column]
    is_number = isinstance(kind, _NUMBERS)
    bad = invalid_number(F.col(column), kind) if is_number else F.lit(False)
    value = F.when(~bad, _text(F.col(column), kind))
    totals = df.agg(F.count_if(missing(F.col(column), kind)).alias("missing"), F.count_if(bad).alias("invalid"), F.count(value).alias("valid"))
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_row"))
    distinct = counts.agg(F.count(F.lit(1)).alias("all_distinct"))
    kept = counts.orderBy("first_row").limit(budget)
    lead = kept.orderBy(F.desc("n"), "value").limit(leaders).agg(F.collect_list(F.struct("n", "value")).alias("l"))
    ordered = F.array_sort(F.transform("l", lambda x: F.struct((-x["n"]).alias("m"), x["value"].alias("value"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["value"], F.lit("="), (-x["m"]).cast("string"))), ",")
    one = totals.join(distinct).join(lead)  # three single rows
    over = F.col("all_distinct") > budget
    return one.select("valid", "missing", "invalid", F.when(over, F.lit(budget + 1).cast("long")).otherwise(F.col("all_distinct")).alias("distinct"), F.when(over, "at_least").otherwise("exact").alias("accuracy"), text.alias("leaders"))


def cohort_missingness(df: DataFrame, columns: Sequence[str], included: str = "included", numeric_columns: Sequence[str] = ()) -> DataFrame:
    """(column, missing, invalid, included) over the cohort, in one wide aggregate."""
    kinds = _kinds(df)
    aggs = [F.count(F.lit(1)).alias("all")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(missing(F.col(c), kinds[c])).alias(f"m{i}"), (F.count_if(invalid_number(F.col(c), kinds[c])) if c in numeric_columns else F.count_if(F.lit(False))).alias(f"i{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"i{i}").alias("invalid"), F.col("all").alias("included")) for i, c in enumerate(columns)]
    return df.where(F.col(included)).agg(*aggs).select(F.inline(F.array(*rows)))
