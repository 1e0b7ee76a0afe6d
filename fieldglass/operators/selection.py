"""Brushed rows: summaries, comparison with all rows, drill-down, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binning import bin_float, bin_integer


def lowest_rows(df: DataFrame, row_id: str, k: int) -> DataFrame:
    """The k rows with the lowest ids, in order; a bounded heap in each task."""
    return df.orderBy(row_id).limit(k)


def scatter_summary(df: DataFrame, selected: Column, x: str, y: str, kind: str) -> DataFrame:
    """One row: selected and total counts, percentage (32-bit), tight ranges, and the top kind; equal counts go to the larger kind."""
    total = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(selected).alias("selected_rows"),
        F.min(F.when(selected, F.col(x))).alias("x_min"), F.max(F.when(selected, F.col(x))).alias("x_max"),
        F.min(F.when(selected, F.col(y))).alias("y_min"), F.max(F.when(selected, F.col(y))).alias("y_max"),
    )
    top = df.where(selected).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "kind")).alias("top"))
    share = F.when(F.col("total_rows") > 0, F.col("selected_rows").cast("float") / F.col("total_rows").cast("float") * F.lit(100.0).cast("float")).otherwise(0.0)
    return total.join(top).select("*", share.cast("float").alias("selected_percentage"), F.col("top.kind").alias("top_kind")).drop("top")


def timeline_summary(df: DataFrame, selected: Column, ts: str, lane: str, value: str, kind: str) -> DataFrame:
    """One row: counts, percentage, ranges of time and value, top lane and top kind; equal counts go to the larger."""
    total = df.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(selected).alias("selected_events"),
        F.min(F.when(selected, F.col(ts))).alias("time_min"), F.max(F.when(selected, F.col(ts))).alias("time_max"),
        F.min(F.when(selected, F.col(value))).alias("value_min"), F.max(F.when(selected, F.col(value))).alias("value_max"),
    )
    inside = df.where(selected)
    lanes = inside.groupBy(F.col(lane).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "v")).alias("lane_top"))
    kinds = inside.groupBy(F.col(kind).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "v")).alias("kind_top"))
    share = F.when(F.col("total_events") > 0, F.col("selected_events") / F.col("total_events") * 100).otherwise(0.0)
    joined = total.join(lanes).join(kinds)  # single rows
    return joined.select(*total.columns, share.alias("selected_percentage"), F.col("lane_top.v").alias("top_lane"), F.col("kind_top.v").alias("top_kind"))


def group_comparison(df: DataFrame, selected: Column, by: str) -> DataFrame:
    """(group, selected, baseline, percentages, delta in points) for each kind or lane; groups are few, so their totals are a window."""
    counts = df.groupBy(F.col(by).alias("group")).agg(F.count_if(selected).alias("selected"), F.count(F.lit(1)).alias("baseline"))
    whole = Window.partitionBy()
    pct = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole) * 100).otherwise(0.0)
    return counts.select("group", "selected", "baseline", pct("selected").alias("selected_pct"), pct("baseline").alias("baseline_pct")).withColumn("delta_pp", F.col("selected_pct") - F.col("baseline_pct"))


def drilldown(df: DataFrame, selected: Column, row_id: str, columns: Sequence[str], k: int = 100) -> DataFrame:
    """(columns, selected_rows, displayed_rows, sampled): the first k selected rows; the counts stand on each."""
    n = df.agg(F.count_if(selected)).first()[0]
    shown = min(n, k)
    rows = lowest_rows(df.where(selected), row_id, k)
    return rows.select(*columns, F.lit(n).cast("long").alias("selected_rows"), F.lit(shown).cast("long").alias("displayed_rows"), F.lit(n > shown).alias("sampled"))


def snapshot_rows(df: DataFrame, snapshot: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is in the snapshot: a semi-join, whose strategy Spark picks by size."""
    return df.join(snapshot.select(row_id), row_id, "left_semi")


def unavailable(snapshot: DataFrame, df: DataFrame, row_id: str) -> DataFrame:
    """Ids of the snapshot that have no row."""
    return snapshot.select(row_id).join(df.select(row_id), row_id, "left_anti")


def source_rows(snapshot: DataFrame, df: DataFrame, row_id: str) -> DataFrame:
    """The snapshot with the columns of its source rows, null where there is none."""
    return snapshot.select(row_id).join(df, row_id, "left")


def snapshot_of(df: DataFrame, selected: Column, row_id: str) -> DataFrame:
    """Distinct selected ids; sorted order is a matter of reading, not of storage."""
    return df.where(selected).select(row_id).distinct()


def selection_bins(df: DataFrame, selected: Column, x: Column, y: Column, box: Sequence[float], width: int = 256, height: int = 256) -> DataFrame:
    """(bin): distinct cells of the selected rows on a grid over the brush box, row 0 at the top."""
    bx = bin_float(x, box[0], box[1], width)
    by = F.lit(height - 1) - bin_float(y, box[2], box[3], height)
    return df.where(selected).select((by * width + bx).alias("bin")).where("bin is not null").distinct()


def timeline_selection_bins(df: DataFrame, selected: Column, ts: Column, lane: Column, time: tuple[int, int], lanes: tuple[int, int], width: int = 256) -> DataFrame:
    """(bin): distinct cells of time (exact integers) by lane in the brush."""
    bx = bin_integer(ts, time[0], time[1], width)
    return df.where(selected & (lane >= lanes[0]) & (lane < lanes[1])).select(((lane - lanes[0]) * width + bx).alias("bin")).where("bin is not null").distinct()


def category_of_rows(rows: DataFrame, columns: Sequence[str], bin_rows: int) -> DataFrame:
    """(column, value, n, sampled): values among the sampled rows of a bin, and whether the bin has more rows than the sample."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    return counts.withColumn("sampled", F.lit(bin_rows > n))


def missingness_comparison(selected: tuple[int, int], baseline: tuple[int, int]) -> dict[str, float]:
    """Missing ratios of a selection and of all rows from (missing, total) pairs, and their difference in points."""
    a, b = (m / t if t else 0.0 for m, t in (selected, baseline))
    return {"selected_ratio": a, "baseline_ratio": b, "delta_pp": (a - b) * 100.0}
