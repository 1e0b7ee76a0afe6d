"""Missing cells by row bucket and column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import row_bucket
from ..functions.cells import missing


def missingness_grid(df: DataFrame, row_id: str, columns: Sequence[str], buckets: int, rows: int | None = None) -> DataFrame:
    """(bucket, column, missing, total): one aggregate by bucket with a counter for each column, then turned to rows.

    ``row_id`` is dense from 0; ``rows`` is their number, counted if not given.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    rows = df.count() if rows is None else rows
    wide = df.groupBy(row_bucket(F.col(row_id), rows, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(missing(F.col(c), kinds[c])).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])
    return wide.select("bucket", "total", F.inline(cells)).select("bucket", "column", "missing", "total")


def missingness_selection(df: DataFrame, row_id: str, columns: Sequence[str], buckets: int, bucket_range: tuple[int, int], column_range: tuple[int, int], keep: int = 10_000) -> DataFrame:
    """One row: missing and total cells of the chosen buckets and columns, rows with a missing cell, and the lowest such row ids.

    Ranges are half-open and cut to the grid.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    b0, b1 = (max(0, min(buckets, b)) for b in bucket_range)
    chosen = list(columns)[max(0, column_range[0]) : max(0, column_range[1])]
    rows = df.count()
    inside = df.withColumn("_b", row_bucket(F.col(row_id), rows, buckets)).where((F.col("_b") >= b0) & (F.col("_b") < b1))
    gaps = sum((missing(F.col(c), kinds[c]).cast("int") for c in chosen), F.lit(0))
    marked = inside.select(F.col(row_id).cast("long").alias("row_id"), gaps.alias("gaps"))
    counts = marked.agg(F.coalesce(F.sum("gaps"), F.lit(0)).cast("long").alias("missing"), (F.count(F.lit(1)) * len(chosen)).alias("total"), F.count_if(F.col("gaps") > 0).alias("rows_with_missing"))
    ids = marked.where("gaps > 0").orderBy("row_id").limit(keep).agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
    return counts.join(ids).withColumn("columns", F.lit(",".join(chosen)))
