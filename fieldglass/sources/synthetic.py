"""Deterministic synthetic tables: every row's draws are addressed by number, so rows are made in parallel.

Rows are made from ``spark.range`` in one array step.  To the optimiser that
step is opaque, so a filter, bin or join over the table plans at once however
long the arithmetic of a draw is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import array_draws, array_unit

# Fixed values of the point pattern.
CLUSTER_CENTER, CLUSTER_SPREAD = (28.0, 72.0), 10.0
EDGE = 0.02
# Fixed values of the event pattern.
GAP, SPIKE, STALE_END, BAND = (220, 280), (460, 500), 120, (760, 820)
VALUES = {"background": (5.0, 25.0), "spike": (15.0, 35.0), "stale_lane": (4.0, 18.0), "high_value_band": (80.0, 120.0)}

_f = np.float32


def _between(u: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """lo + u * (hi - lo), each step in 32 bits."""
    return _f(lo) + u * (_f(hi) - _f(lo))


def _point_rows(i: np.ndarray, rows: int, seed: int, x: tuple[float, float], y: tuple[float, float]) -> dict[str, np.ndarray]:
    background, outliers = rows // 4, max(1, rows // 20)
    cluster = max(0, rows - background - outliers)
    # a cluster row takes six draws, a background row two, an outlier three
    first = np.where(i < cluster, i * 6, np.where(i < cluster + background, 6 * cluster + (i - cluster) * 2, 6 * cluster + 2 * background + (i - cluster - background) * 3))
    d = [array_draws(seed, first + k) for k in range(6)]
    u = [array_unit(v) for v in d]
    group = np.where(i < cluster, 0, np.where(i < cluster + background, 1, 2))
    side = d[0] % np.uint64(4)

    def clustered(a: int, center: float, lo: float, hi: float) -> np.ndarray:
        mean = (u[a] + u[a + 1] + u[a + 2]) / _f(3.0)
        return np.clip(_f(center) + (mean - _f(0.5)) * _f(CLUSTER_SPREAD), _f(lo), _f(hi))

    def corner(k: int, low: np.ndarray, lo: float, hi: float) -> np.ndarray:
        by = _between(u[k], 0.0, (hi - lo) * EDGE)
        return np.where(low, _f(lo) + by, _f(hi) - by)

    return {
        "row_id": i,
        "x": np.choose(group, (clustered(0, CLUSTER_CENTER[0], *x), _between(u[0], *x), corner(1, side % 2 == 0, *x))),
        "y": np.choose(group, (clustered(3, CLUSTER_CENTER[1], *y), _between(u[1], *y), corner(2, side < 2, *y))),
        "kind": np.array(["cluster", "background", "outlier"])[group],
    }


def synthetic_points(spark: SparkSession, rows: int, seed: int = 42, x: tuple[float, float] = (0.0, 100.0), y: tuple[float, float] = (0.0, 100.0)) -> DataFrame:
    """(row_id, x, y, kind): a cluster, a quarter of background and a twentieth of outliers in the corners."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _point_rows(b.column(0).to_numpy(), rows, seed, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return spark.range(rows).mapInArrow(make, "row_id long, x float, y float, kind string")


def _event_rows(i: np.ndarray, rows: int, seed: int, time: tuple[int, int], lanes: int) -> dict[str, np.ndarray]:
    lo, hi = time
    spike, stale, band = rows // 4, rows // 10, rows // 8
    background = rows - spike - stale - band
    sizes, draws = (background, spike, stale, band), (4, 3, 2, 3)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:4]
    used = np.concatenate(([0], np.cumsum(np.multiply(sizes, draws))))[:4]
    group = np.searchsorted(starts[1:], i, "right")
    first = used[group] + (i - starts[group]) * np.array(draws)[group]
    d = [array_draws(seed, first + k) for k in range(4)]
    below = lambda k, n: (d[k] % np.uint64(n)).astype(np.int64)
    within = lambda k, a, b: below(k, b - a + 1) + a
    early, late = (lo, min(GAP[0] - 1, hi)), (max(GAP[1] + 1, lo), hi)
    is_early = below(0, early[1] - early[0] + 1 + late[1] - late[0] + 1) < early[1] - early[0] + 1
    stale_lane = np.full(len(i), lanes - 1, dtype=np.int64)
    times = (np.where(is_early, within(1, *early), within(1, *late)), within(0, max(lo, SPIKE[0]), min(hi, SPIKE[1])), within(0, lo, min(hi, STALE_END)), within(1, max(lo, BAND[0]), min(hi, BAND[1])))
    # in the last group the lane is drawn before the time
    placed = (below(2, lanes - 1), below(1, lanes - 1), stale_lane, below(0, min(lanes - 1, 3) + 1))
    values = [_between(array_unit(d[k]), *VALUES[name]) for name, k in zip(VALUES, (3, 2, 1, 2), strict=True)]
    return {"row_id": i, "ts": np.choose(group, times), "lane": np.choose(group, placed).astype(np.int32), "value": np.choose(group, values), "kind": np.array(list(VALUES))[group]}


def synthetic_events(spark: SparkSession, rows: int, seed: int = 42, time: tuple[int, int] = (0, 1_000), lanes: int = 8) -> DataFrame:
    """(row_id, ts, lane, value, kind): background outside a gap, a spike, a lane that goes stale, and a band of high values.

    The time range must reach beyond the patterns on both sides, so every row
    takes the same number of draws.
    """
    lo, hi = time
    if lanes < 2:
        raise ValueError("a synthetic timeline needs at least two lanes")
    if not (lo < STALE_END and lo < GAP[0] - 1 and hi > GAP[1] + 1 and hi > BAND[0] and hi > SPIKE[0] and hi - lo < 2**31):
        raise ValueError("the time range does not hold the synthetic patterns")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _event_rows(b.column(0).to_numpy(), rows, seed, time, lanes)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return spark.range(rows).mapInArrow(make, "row_id long, ts long, lane int, value float, kind string")
