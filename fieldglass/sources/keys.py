"""Natural keys: trimmed, not blank, unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_blank, trim_ws

#: Bytes an index entry takes besides its text.
ENTRY_BYTES = 32


def key_report(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct keys, blank keys, rows of repeated keys, and the index size in bytes."""
    key = trim_ws(F.col(column).cast("string"))
    blank = is_blank(F.col(column))
    keys = df.select(F.when(~blank, key).alias("k"), blank.alias("b")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("k").isNotNull()).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("blank_keys"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.octet_length("k") + ENTRY_BYTES)), F.lit(0)).alias("index_bytes"),
    )


def duplicate_keys(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(key, first_row, second_row) of repeated keys; the two lowest row ids come from mergeable aggregates."""
    key = trim_ws(F.col(column).cast("string"))
    rows = df.where(~is_blank(F.col(column))).select(key.alias("key"), F.col(row_id).alias("r"))
    first = rows.groupBy("key").agg(F.min("r").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = rows.join(first, "key").where("r > first_row").groupBy("key", "first_row").agg(F.min("r").alias("second_row"))
    return later.select("key", "first_row", "second_row")


def validate_key(df: DataFrame, column: str, row_id: str, budget_bytes: int | None = None) -> None:
    """Raise for an unknown column, blank or repeated keys (naming the first two rows), or an index over the budget."""
    if column not in df.columns:
        raise ValueError(f"key column {column!r} does not exist")
    r = key_report(df, column).first()
    if r.blank_keys:
        raise ValueError(f"key column {column!r} has {r.blank_keys} blank keys")
    if r.repeated_rows:
        d = duplicate_keys(df, column, row_id).orderBy("second_row").first()
        raise ValueError(f"key {d.key!r} of column {column!r} is on rows {d.first_row} and {d.second_row}")
    if budget_bytes is not None and r.index_bytes > budget_bytes:
        raise ValueError(f"the key index needs {r.index_bytes} bytes, {budget_bytes} are allowed")
