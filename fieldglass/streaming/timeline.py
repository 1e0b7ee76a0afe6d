"""Timeline counts over a stream: count grids are additive, so they update as events arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import micros
from ..operators.fields import binned_timeline


def windowed_lanes(events: DataFrame, ts: str, lane: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, lane, n): events by time window and lane; state older than the watermark is dropped."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(lane).alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "lane", "n")


def streaming_density(events: DataFrame, ts: Column, lane: Column, time: tuple[int, int], lanes: int, width: int, height: int) -> DataFrame:
    """(bx, by, n) over a fixed domain, for update or complete mode; state is one count a cell."""
    return binned_timeline(events, ts, lane, time, lanes, width, height).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def event_micros(ts: str) -> Column:
    return micros(F.col(ts))
