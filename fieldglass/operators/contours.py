"""Order statistics of grids: mass contours, percentiles, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fields import densify


def mass_contours(grid: DataFrame, basis_points: Sequence[int]) -> DataFrame:
    """(basis_points, threshold, enclosed, total): the count c such that cells of c or more hold that fraction of all rows.

    The target is rounded up and ties are enclosed whole.  Cells are counted by
    their count first; the window runs over distinct counts.
    """
    wanted = list(dict.fromkeys(basis_points))
    if not wanted or any(not 1 <= b <= 10_000 for b in wanted):
        raise ValueError("fractions are 1 to 10000 basis points")
    by_count = grid.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    mass = by_count.select("n", F.sum(F.col("n") * F.col("cells")).over(down).alias("enclosed"), F.sum(F.col("n") * F.col("cells")).over(Window.partitionBy()).alias("total"))
    wants = F.explode(F.array(*[F.lit(b) for b in wanted]))
    each = mass.select("*", wants.alias("basis_points"))
    target = F.call_function("div", F.col("total") * F.col("basis_points") + 9_999, F.lit(10_000).cast("long"))
    return each.where(F.col("enclosed") >= target).groupBy("basis_points").agg(F.max("n").alias("threshold"), F.min("enclosed").alias("enclosed"), F.max("total").alias("total"))


def density_percentile(grid: DataFrame) -> DataFrame:
    """(n, percentile): share of occupied cells whose count is at most n."""
    by_count = grid.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return by_count.select("n", (F.sum("cells").over(up) / F.sum("cells").over(Window.partitionBy())).alias("percentile"))


def neighbourhood(grid: DataFrame, width: int, height: int) -> DataFrame:
    """(bx, by, n, around): the sum over the 3 x 3 cells around each cell, cut at the edges.

    Occupied cells send their count to the nine cells around them; no window
    or join is needed.
    """
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), dx -> transform(sequence(-1, 1), dy -> struct(bx + dx as x, by + dy as y, case when dx = 0 and dy = 0 then n else 0 end as own))))"))
    sent = grid.select("n", near.alias("c")).where(F.col("c.x").between(0, width - 1) & F.col("c.y").between(0, height - 1))
    sums = sent.groupBy(F.col("c.x").cast("int").alias("bx"), F.col("c.y").cast("int").alias("by")).agg(F.sum("c.own").cast("long").alias("n"), F.sum("n").alias("around"))
    return densify(sums, width, height, ("n", "around")).drop("cell")
