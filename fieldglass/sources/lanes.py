"""Lane dictionaries: ids in the order in which labels are first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import trim_ws


def lane_dictionary(df: DataFrame, lane: str, row_id: str) -> DataFrame:
    """(lane, label, first_row): one partial aggregate; the window runs over labels, not rows."""
    first = df.groupBy(trim_ws(F.col(lane).cast("string")).alias("label")).agg(F.min(row_id).alias("first_row"))
    return first.select((F.row_number().over(Window.orderBy("first_row", "label")) - 1).alias("lane"), "label", "first_row")


def with_lane(df: DataFrame, lanes: DataFrame, lane: str, out: str = "lane") -> DataFrame:
    """Add the lane id; Spark broadcasts the dictionary when its size allows."""
    named = lanes.select(F.col("label").alias("_label"), F.col("lane").alias("_lane"))
    joined = df.withColumn("_label", trim_ws(F.col(lane).cast("string"))).join(named, "_label", "left")
    keep = [c for c in df.columns if c != out]
    return joined.select(*keep, F.col("_lane").alias(out))
