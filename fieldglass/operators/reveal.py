"""Which single points to show: a stable pseudo-random subset of a view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import with_priority
from .filters import in_box

MAX_POINTS = 20_000


def reveal_plan(df: DataFrame, x: Column, y: Column, box: Sequence[float], row_id: str, included: Column | None = None, most: int = MAX_POINTS) -> DataFrame:
    """(row_id, px, py): of the rows in view and cohort, the ``most`` with the lowest stable priority.

    A bounded heap in each task; ids break ties.  The choice does not depend
    on order or partitioning, and a smaller limit gives a subset.
    """
    eligible = df.where(in_box(x, y, box) & (F.lit(True) if included is None else included))
    points = eligible.select(F.col(row_id).cast("long").alias("row_id"), x.alias("px"), y.alias("py"))
    return with_priority(points, "row_id", "_p").orderBy("_p", "row_id").limit(most).drop("_p")


def reveal_blend(rows_per_pixel: float, fully_below: float, hidden_above: float) -> float:
    """1 where points are shown fully, 0 where they are hidden, linear in between."""
    if not 0 <= fully_below < hidden_above:
        raise ValueError("thresholds must be non-negative and increasing")
    return min(1.0, max(0.0, (hidden_above - rows_per_pixel) / (hidden_above - fully_below)))


def reveal_selection(df: DataFrame, x: Column, y: Column, box: Sequence[float], row_id: str, plot: tuple[int, int], fully_below: float = 0.02, hidden_above: float = 0.12, included: Column | None = None, most: int = MAX_POINTS, mode: str = "auto") -> tuple[DataFrame, dict]:
    """The reveal plan with its decision: empty when off or hidden; one count reaches the driver."""
    if plot[0] < 1 or plot[1] < 1:
        raise ValueError("the plot has no pixels")
    keep = in_box(x, y, box) & (F.lit(True) if included is None else included)
    eligible = df.agg(F.count_if(keep)).first()[0]
    blend = 0.0 if mode == "off" else reveal_blend(eligible / (plot[0] * plot[1]), fully_below, hidden_above)
    shown = most if blend > 0 else 0
    points = reveal_plan(df, x, y, box, row_id, included, shown)
    return points, {"eligible": eligible, "blend": blend, "sampled": blend > 0 and eligible > most}
