"""A cohort against its baseline: share differences of a grid, in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encodings import fixed_abs_delta, support_aware
from .fields import marginals


def cohort_totals(df: DataFrame, included: str = "included") -> tuple[int, int]:
    """Row totals (baseline, active), before any viewport; a side without rows is an error."""
    base, active = df.agg(F.count(F.lit(1)), F.count_if(F.col(included))).first()
    if not base or not active:
        raise ValueError("a comparison needs rows on both sides")
    return base, active


def difference_grid(binned_df: DataFrame, totals: tuple[int, int], included: str = "included") -> DataFrame:
    """(bx, by, baseline, active, shares, signed_delta, support_share) of occupied cells.

    Shares are of the cohorts' row totals, also when the view leaves rows out.
    Both sides come from one conditional aggregate.
    """
    grid = binned_df.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("baseline"), F.count_if(F.col(included)).alias("active"))
    a, b = F.col("active") / F.lit(float(totals[1])), F.col("baseline") / F.lit(float(totals[0]))
    return grid.withColumns({"baseline_share": b, "active_share": a}).withColumns({"signed_delta": F.col("active_share") - F.col("baseline_share"), "support_share": (F.col("active_share") + F.col("baseline_share")) / 2})


def difference_maxima(diff: DataFrame) -> tuple[float, float]:
    """(largest absolute delta, largest support), two numbers."""
    r = diff.agg(F.max(F.abs("signed_delta")), F.max("support_share")).first()
    return r[0] or 0.0, r[1] or 0.0


def with_visibility(diff: DataFrame) -> DataFrame:
    """Add normalized_delta and support_visibility relative to the grid's maxima."""
    d, s = difference_maxima(diff)
    return diff.withColumn("_v", support_aware(F.col("signed_delta"), F.col("support_share"), F.lit(d), F.lit(s))).select(*diff.columns, "_v.*")


def with_direction(diff: DataFrame) -> DataFrame:
    """Add ``direction``: over, under or same share in the cohort."""
    return diff.withColumn("direction", F.when(F.col("signed_delta") > 0, "over").when(F.col("signed_delta") < 0, "under").otherwise("same"))


def with_delta_percentile(diff: DataFrame) -> DataFrame:
    """Add ``delta_percentile``: share of the cells with a difference whose fixed-point delta is at most this one; null without a difference.

    Deltas are counted first, so the running sum sees distinct values, not cells.
    """
    fixed = diff.withColumn("fixed", fixed_abs_delta(F.col("signed_delta")))
    counts = fixed.where("fixed > 0").groupBy("fixed").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("fixed").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.select("fixed", (F.sum("n").over(running) / F.sum("n").over(Window.partitionBy())).alias("delta_percentile"))
    return fixed.join(ranks, "fixed", "left").select(*diff.columns, "delta_percentile")


def comparison_marginals(diff: DataFrame) -> DataFrame:
    """(axis, bin, baseline, active, shared_max): both marginals with one scale for each axis."""
    base = marginals(diff.select("bx", "by", F.col("baseline").alias("n"))).withColumnRenamed("n", "baseline")
    active = marginals(diff.select("bx", "by", F.col("active").alias("n"))).withColumnRenamed("n", "active")
    both = base.join(active, ["axis", "bin"])
    return both.withColumn("shared_max", F.max(F.greatest("baseline", "active")).over(Window.partitionBy("axis")))
