"""Intervals: islands of true samples, comparison of two sets of windows, sample states.

Positions are integers and intervals are half-open.  Work is partitioned by
the ``keys`` columns; a key's boundaries are ordered within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAMILIES = ("overlap", "residual", "missing", "symmetric_difference", "gap")


def contiguous_ranges(df: DataFrame, position: str, active: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end) of the runs of consecutive active positions."""
    rows = df.where(F.coalesce(active, F.lit(False))).select(*keys, F.col(position).cast("long").alias("p")).distinct()
    order = Window.partitionBy(*keys).orderBy("p")
    islands = rows.withColumn("island", F.col("p") - F.row_number().over(order))
    return islands.groupBy(*keys, "island").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("end")).drop("island")


def boundary_events(windows: DataFrame, source: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, position, active, source): a start and an end for each window; at a position ends sort before starts."""
    ends = F.array(F.struct(F.col("start").alias("position"), F.lit(1).alias("active")), F.struct(F.col("end").alias("position"), F.lit(0).alias("active")))
    return windows.select(*keys, F.inline(ends)).withColumn("source", F.lit(source))


def segments(target: DataFrame, against: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end, t, a): elementary segments between boundaries, with the number of windows of each side that cover them.

    Boundaries are summed by position before the running sums, so repeated
    windows cost one row a position.
    """
    sides = []
    for df, t, a in ((target, 1, 0), (against, 0, 1)):
        both = F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))
        sides.append(df.where("start < end").select(*keys, F.inline(both)).select(*keys, "p", (F.col("d") * t).alias("dt"), (F.col("d") * a).alias("da")))
    steps = sides[0].unionByName(sides[1]).groupBy(*keys, "p").agg(F.sum("dt").alias("dt"), F.sum("da").alias("da"))
    order = Window.partitionBy(*keys).orderBy("p")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = steps.select(*keys, F.col("p").alias("start"), F.lead("p").over(order).alias("end"), F.sum("dt").over(running).alias("t"), F.sum("da").over(running).alias("a"))
    return cut.where("end is not null")


def compare_intervals(target: DataFrame, against: DataFrame, keys: Sequence[str] = (), families: Sequence[str] = FAMILIES) -> DataFrame:
    """(keys, family, side, start, end) of each family, adjacent segments of one class merged.

    overlap: both sides; residual: target only; missing: against only;
    symmetric_difference: either alone, with its side; gap: neither, between
    the first and the last boundary.
    """
    bad = set(families) - set(FAMILIES)
    if bad:
        raise ValueError(f"unknown families {sorted(bad)}")
    s = segments(target, against, keys)
    t, a = F.col("t") > 0, F.col("a") > 0
    side = F.when(t & ~a, "target").when(a & ~t, "against")
    named = F.array(
        F.when(t & a, F.struct(F.lit("overlap").alias("family"), F.lit(None).cast("string").alias("side"))),
        F.when(t & ~a, F.struct(F.lit("residual").alias("family"), F.lit(None).cast("string").alias("side"))),
        F.when(a & ~t, F.struct(F.lit("missing").alias("family"), F.lit(None).cast("string").alias("side"))),
        F.when(t != a, F.struct(F.lit("symmetric_difference").alias("family"), side.alias("side"))),
        F.when(~t & ~a, F.struct(F.lit("gap").alias("family"), F.lit(None).cast("string").alias("side"))),
    )
    rows = s.select(*keys, "start", "end", F.explode(F.array_compact(named)).alias("f")).select(*keys, "start", "end", "f.family", "f.side")
    return merge_adjacent(rows.where(F.col("family").isin(list(families))), [*keys, "family", "side"])


def merge_adjacent(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join intervals of equal ``by`` that touch."""
    order = Window.partitionBy(*by).orderBy("start")
    opens = (F.lag("end").over(order) != F.col("start")) | F.lag("end").over(order).isNull()
    marked = rows.withColumn("_open", opens.cast("int")).withColumn("_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def coverage(target: DataFrame, against: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end, target_magnitude, covered_magnitude, ratio): target segments, split where coverage changes."""
    s = segments(target, against, keys).where("t > 0").select(*keys, "start", "end", (F.col("a") > 0).alias("covered"))
    merged = merge_adjacent(s, [*keys, "covered"])
    length = F.col("end") - F.col("start")
    shaped = merged.select(*keys, "start", "end", length.alias("target_magnitude"), F.when(F.col("covered"), length).otherwise(0).alias("covered_magnitude"))
    return shaped.withColumn("ratio", F.when(F.col("target_magnitude") > 0, F.col("covered_magnitude") / F.col("target_magnitude")))


def containment(target: DataFrame, against: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end, status) of each target window; this engine's own definition.

    contained: inside one merged against-window; left_overhang or
    right_overhang: reaches out of it on that side only; else not_contained.
    Both sides are unions; an against-window is found by the last start at or
    before the target's end, so no range join is needed.
    """
    against = merge_overlapping(against, keys)
    marks = against.select(*keys, F.col("start").alias("p"), F.lit(0).alias("kind"), F.col("start").alias("s"), F.col("end").alias("e"))
    asks = target.select(*keys, (F.col("end") - 1).alias("p"), F.lit(1).alias("kind"), F.col("start").alias("s"), F.col("end").alias("e"))
    order = Window.partitionBy(*keys).orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("kind") == 0, F.struct("s", "e")), ignorenulls=True).over(order)
    rows = marks.unionByName(asks).withColumn("near", near).where("kind = 1")
    touches = F.coalesce(F.col("near.e") > F.col("s"), F.lit(False))
    left, right = F.col("s") < F.col("near.s"), F.col("e") > F.col("near.e")
    status = F.when(~touches | (left & right), "not_contained").when(left, "left_overhang").when(right, "right_overhang").otherwise("contained")
    return rows.select(*keys, F.col("s").alias("start"), F.col("e").alias("end"), status.alias("status"))


def merge_overlapping(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The union of windows, as disjoint ones."""
    nothing = windows.limit(0)
    covered = segments(windows, nothing, keys).where("t > 0").select(*keys, "start", "end")
    return merge_adjacent(covered, list(keys)) if keys else merge_adjacent(covered.withColumn("_k", F.lit(0)), ["_k"]).drop("_k")


def shape_rows(intervals: DataFrame, origin: int | None = None) -> DataFrame:
    """Add ``origin``, ``start_offset`` and ``duration``; a negative duration is an error."""
    low, bad = intervals.agg(F.min("start"), F.count_if(F.col("end") < F.col("start"))).first()
    if bad:
        raise ValueError(f"{bad} intervals end before they start")
    origin = low if origin is None else origin
    return intervals.withColumns({"origin": F.lit(origin).cast("long"), "start_offset": (F.col("start") - F.lit(origin)).cast("double"), "duration": F.col("end") - F.col("start")})


def interval_rollup(intervals: DataFrame, covered: DataFrame) -> DataFrame:
    """(family, intervals, total, mean, overall target, covered and ratio)."""
    each = intervals.groupBy("family").agg(F.count(F.lit(1)).alias("interval_count"), F.sum(F.col("end") - F.col("start")).alias("total_duration"))
    whole = covered.agg(F.sum("target_magnitude").alias("target_total"), F.sum("covered_magnitude").alias("covered_total"))
    both = each.join(whole)  # one row on the right
    return both.select("family", "interval_count", "total_duration", (F.col("total_duration") / F.col("interval_count")).alias("mean_duration"), "target_total", "covered_total", F.when(F.col("target_total") > 0, F.col("covered_total") / F.col("target_total")).alias("coverage_ratio"))


STATES = {"overlap": "detected_anomaly", "residual": "missed_anomaly", "missing": "false_positive"}


def state_timeline(samples: DataFrame, position: str, intervals: DataFrame, keys: Sequence[str] = (), check: bool = False) -> DataFrame:
    """Samples with ``comparison_state`` of the interval that holds them, 'outside_anomaly' without one.

    The three state families of a comparison are disjoint, so the interval of
    a sample is the last that started at or before it: a union and one running
    window instead of a range join.  ``check`` raises when families overlap.
    """
    own = intervals.where(F.col("family").isin(list(STATES)))
    if check:
        order = Window.partitionBy(*keys).orderBy("start", "end")
        clash = own.withColumn("_e", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("_e > start").limit(1).count()
        if clash:
            raise ValueError("a sample belongs to conflicting interval families")
    cols = samples.columns
    left = samples.select(*keys, F.struct(*cols).alias("_s"), F.col(position).cast("long").alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast("struct<e:bigint,f:string>").alias("_i"))
    right = own.select(*keys, F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), F.col("start").cast("long").alias("_p"), F.lit(0).alias("_k"), F.struct(F.col("end").cast("long").alias("e"), F.col("family").alias("f")).alias("_i"))
    order = Window.partitionBy(*keys).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_i", ignorenulls=True).over(order)
    rows = left.unionByName(right).withColumn("_i", last).where("_k = 1")
    state = F.lit("outside_anomaly")
    for family, name in STATES.items():
        state = F.when((F.col("_i.e") > F.col("_p")) & (F.col("_i.f") == family), name).otherwise(state)
    return rows.select("_s.*", state.alias("comparison_state"))


def label_ranges(labels: DataFrame, samples: DataFrame, ts: str, position: str) -> DataFrame:
    """(start, end) positions of label windows given by first and last timestamp, the last included; a boundary without a sample is an error."""
    at = samples.select(F.col(ts).alias("_t"), F.col(position).cast("long").alias("_p"))
    starts = labels.join(at.select(F.col("_t").alias("start_ts"), F.col("_p").alias("start")), "start_ts", "left")
    both = starts.join(at.select(F.col("_t").alias("end_ts"), (F.col("_p") + 1).alias("end")), "end_ts", "left")
    if both.where("start is null or end is null").limit(1).count():
        raise ValueError("a label boundary is not a sample's timestamp")
    return both.select("start", "end")


def aligned(samples: DataFrame, detector: DataFrame, position: str, ts: str) -> DataFrame:
    """Samples joined one to one with a detector's rows by position and timestamp; any difference is an error."""
    both = samples.join(detector, [position, ts], "full_outer").withColumn("_n", F.lit(1))
    if both.count() != samples.count() or both.count() != detector.count():
        raise ValueError("the detector's rows do not align with the samples")
    return both.drop("_n")
