"""Connected components of an edge table, by alternating star operations on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import discard, hot_keys, materialize, salted_join

MAX_ROUNDS = 60


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u > v) that join the same nodes: in each batch of rows, every node is linked to the smallest it is joined with there.

    A batch has a bounded number of rows, so a task holds little; long chains
    in it take no rounds of shuffles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                top = x
                while (t := up.setdefault(top, top)) != top:
                    top = t
                while x != top:
                    up[x], x = top, up[x]
                return top

            for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
            rows = [(x, root(x)) for x in up]
            yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"]).astype("int64")

    return edges.mapInPandas(run, "u long, v long")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it; the edges of a hub, of n edges, are dealt over tasks."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    return salted_join(larger, least, "u", "v", hot_keys(larger, "u", n)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); a component is named by its smallest node.

    Edges are first reduced to forests batch by batch.  Rounds end when they stop
    changing; each is written to the shared folder.  Only two numbers a round reach the driver.  Loops, repeated edges
    and nulls are ignored; no edges give no rows.
    """
    ordered = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mark_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    now = materialize(forest(ordered).distinct(), "edges")
    mark = mark_of(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        larger = materialize(_large_star(now, mark[0]), "edges")
        after = materialize(_small_star(larger), "edges")
        discard(now)
        discard(larger)
        now, seen = after, mark_of(after)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
