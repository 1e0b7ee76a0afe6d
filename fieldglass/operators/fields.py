"""Density fields: sparse (bx, by, n) grids by partial aggregation, marginals, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binning import bin_float, bin_integer, bin_lane, check_bins, check_domain


def binned(df: DataFrame, x: Column, y: Column, domain: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Add ``bx`` and ``by``; rows outside the domain on either axis are dropped."""
    check_bins(width, height)
    check_domain(domain[0], domain[1])
    check_domain(domain[2], domain[3])
    out = df.withColumn("bx", bin_float(x, domain[0], domain[1], width)).withColumn("by", bin_float(y, domain[2], domain[3], height))
    return out.where(F.col("bx").isNotNull() & F.col("by").isNotNull())


def binned_timeline(df: DataFrame, ts: Column, lane: Column, time: tuple[int, int], lanes: int, width: int, height: int) -> DataFrame:
    """Add ``bx`` (time, exact integer bins) and ``by`` (lane); rows outside are dropped."""
    check_bins(width, height)
    out = df.withColumn("bx", bin_integer(ts, time[0], time[1], width)).withColumn("by", bin_lane(lane, lanes, height))
    return out.where(F.col("bx").isNotNull() & F.col("by").isNotNull())


def density(binned_df: DataFrame, *extra: Column) -> DataFrame:
    """(bx, by, n, ...): one shuffle of partial counts."""
    return binned_df.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), *extra)


def densify(grid: DataFrame, width: int, height: int, counts: tuple[str, ...] = ("n",)) -> DataFrame:
    """Every cell, row by row as ``cell`` = by * width + bx, with 0 where the grid has none."""
    check_bins(width, height)
    cells = grid.sparkSession.range(width * height).select(F.col("id").alias("cell"), (F.col("id") % width).cast("int").alias("bx"), F.call_function("div", F.col("id"), F.lit(width).cast("long")).cast("int").alias("by"))
    return cells.join(grid, ["bx", "by"], "left").select("cell", "bx", "by", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def dense_counts(grid: DataFrame, width: int, height: int) -> DataFrame:
    """One row: all counts in row order as an array, their total and maximum; the grid is small by construction."""
    pairs = F.array_sort(F.collect_list(F.struct("cell", "n")))
    return densify(grid, width, height).agg(F.transform(pairs, lambda p: p["n"]).alias("counts"), F.sum("n").alias("total"), F.max("n").alias("max_count"))


def marginals(grid: DataFrame) -> DataFrame:
    """(axis, bin, n): both axes of a grid in one pass of grouping sets."""
    sides = grid.select(F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("bx").alias("bin")), F.struct(F.lit("y").alias("axis"), F.col("by").alias("bin")))).alias("s"), "n")
    return sides.groupBy("s.axis", "s.bin").agg(F.sum("n").alias("n"))


def marginal_maxima(grid: DataFrame) -> DataFrame:
    """(axis, bins, total, max_n) of each axis."""
    return marginals(grid).groupBy("axis").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("total"), F.max("n").alias("max_n"))


def overview(binned_df: DataFrame, row_id: str, keep: int) -> DataFrame:
    """(bx, by, n, row_ids): counts with the ``keep`` lowest row ids of each bin, sorted.

    Ranks in a bin are cut before they are collected, so no bin's ids are
    gathered whole.  A first cut inside each task's slice of a bin keeps a bin
    that holds much of the table from one task.
    """
    slice_ = F.pmod(F.xxhash64(row_id), F.lit(64))
    cut = binned_df.select("bx", "by", F.col(row_id).cast("long").alias("row_id"), slice_.alias("slice"))
    counts = cut.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("bx", "by", "slice").orderBy("row_id")
    some = cut.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    final = Window.partitionBy("bx", "by").orderBy("row_id")
    few = some.withColumn("r", F.row_number().over(final)).where(F.col("r") <= keep)
    ids = few.groupBy("bx", "by").agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
    return counts.join(ids, ["bx", "by"])


def bin_count_histogram(grid: DataFrame) -> DataFrame:
    """(n, bins): how many occupied bins have each count."""
    return grid.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("bins"))


def time_overview(df: DataFrame, ts: Column, full: tuple[int, int], window: tuple[int, int], bins: int) -> DataFrame:
    """(bin, n, window_start, window_end): histogram of the full range with the window's place in it as fractions."""
    span = max(1, full[1] - full[0])
    at = lambda t: min(1.0, max(0.0, (t - full[0]) / span))
    placed = df.select(bin_integer(ts, full[0], full[1], bins).alias("bin")).where("bin is not null")
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("window_start", F.lit(at(window[0]))).withColumn("window_end", F.lit(at(window[1])))
