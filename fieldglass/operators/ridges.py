"""Density ridges of an aggregated grid: where counts crest along a line.

The grid is cut into square tiles, each with a border as wide as a cell's
result looks; numpy works on one tile at a time, so a task's memory does not
depend on the size of the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import MAX_FIELD_BINS

# Binomial kernels and their variances in cells.
KERNELS = {"fine": [1, 2, 1], "medium": [1, 4, 6, 4, 1], "coarse": [1, 8, 28, 56, 70, 56, 28, 8, 1]}
VARIANCE = {"fine": 0.5, "medium": 1.0, "coarse": 2.0}
TINY = 1e-12
#: Cells of a tile's side.
TILE = 512


def smooth(counts: np.ndarray, scale: str) -> np.ndarray:
    """Separable binomial blur; the edge cell is repeated outwards."""
    kernel = np.array(KERNELS[scale], dtype=float)
    kernel /= kernel.sum()
    r = len(kernel) // 2
    out = counts.astype(float)
    for axis in (1, 0):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return out


class Around:
    """Every cell's neighbours, the edge cell repeated outwards."""

    def __init__(self, v: np.ndarray) -> None:
        self.shape = v.shape
        self.wide = np.pad(v, 1, mode="edge")

    def __call__(self, dy: int, dx: int) -> np.ndarray:
        h, w = self.shape
        return self.wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    def step(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bilinear values one step (x, y) of at most a cell away."""

        def line(dy: int) -> np.ndarray:
            low, mid, high = (self(dy, dx) for dx in (-1, 0, 1))
            return np.where(x < 0, low + (mid - low) * (x + 1), mid + (high - mid) * x)

        low, mid, high = (line(dy) for dy in (-1, 0, 1))
        return np.where(y < 0, low + (mid - low) * (y + 1), mid + (high - mid) * y)


def crests(counts: np.ndarray, scale: str, min_anisotropy: float, sx: float, sy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw strength, normal x, normal y) of each cell; 0 where there is no ridge.  ``sx`` and ``sy`` are a cell's share of the grid.

    A ridge cell has a negative smaller Hessian eigenvalue, enough anisotropy,
    and is not below its neighbours along that eigenvector, and above one.
    """
    v = smooth(counts, scale)
    at = Around(v)
    dxx = (at(0, 1) - 2 * v + at(0, -1)) / (sx * sx)
    dyy = (at(1, 0) - 2 * v + at(-1, 0)) / (sy * sy)
    dxy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * sx * sy)
    mean, half = (dxx + dyy) / 2, (dxx - dyy) / 2
    root = np.sqrt(half * half + dxy * dxy)
    low, high = mean - root, mean + root
    ax, ay, bx, by = dxy, low - dxx, low - dyy, dxy
    first = ax * ax + ay * ay >= bx * bx + by * by
    nx, ny = np.where(first, ax, bx), np.where(first, ay, by)
    size = np.sqrt(nx * nx + ny * ny)
    has = (root > TINY) & (size > TINY)
    nx, ny = (np.where(has, a / np.where(has, size, 1), 0.0) for a in (nx, ny))
    plus, minus = at.step(nx, ny), at.step(-nx, -ny)
    crest = has & (v >= plus) & (v >= minus) & ((v > plus) | (v > minus))
    gap = np.abs(high - low)
    ridge = crest & (low < 0) & (gap / (np.abs(high) + np.abs(low) + TINY) >= min_anisotropy) & (gap > TINY)
    return np.where(ridge, VARIANCE[scale] * np.maximum(-low, 0.0), 0.0), nx, ny


def _tiles(at: Column, size: int, border: int) -> Column:
    """The tiles that hold a cell, in their border or inside."""
    tile = lambda c: F.call_function("div", c, F.lit(TILE)).cast("int")
    return F.explode(F.sequence(tile(F.greatest(at - border, F.lit(0))), tile(F.least(at + border, F.lit(size - 1)))))


def density_ridges(grid: DataFrame, width: int, height: int, scale: str = "medium", min_strength_bp: int = 250, min_anisotropy_bp: int = 1_500) -> DataFrame:
    """(bx, by, strength, tangent_x, tangent_y) of the ridge cells of a sparse grid (bx, by, n).

    Strength is relative to the strongest cell; tangents point to +x, or +y
    where they are vertical.
    """
    if width * height > MAX_FIELD_BINS:
        raise ValueError(f"ridges take grids of up to {MAX_FIELD_BINS} cells")
    if scale not in KERNELS or not (0 <= min_strength_bp <= 10_000 and 0 <= min_anisotropy_bp <= 10_000):
        raise ValueError("unknown scale or basis points beyond 10000")
    border = len(KERNELS[scale]) // 2 + 1
    sx, sy = 1.0 / max(1, width - 1), 1.0 / max(1, height - 1)

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        x, y = (TILE * int(k) for k in key)
        x0, y0 = max(0, x - border), max(0, y - border)
        dense = np.zeros((min(height, y + TILE + border) - y0, min(width, x + TILE + border) - x0))
        dense[cells["by"] - y0, cells["bx"] - x0] = cells["n"]
        inside = (slice(y - y0, y - y0 + TILE), slice(x - x0, x - x0 + TILE))
        raw, nx, ny = (a[inside] for a in crests(dense, scale, min_anisotropy_bp / 10_000, sx, sy))
        at = np.nonzero(raw)
        return pd.DataFrame({"bx": at[1] + x, "by": at[0] + y, "raw": raw[at], "nx": nx[at], "ny": ny[at]})

    tiled = grid.select("bx", "by", "n", _tiles(F.col("bx"), width, border).alias("tx")).select("*", _tiles(F.col("by"), height, border).alias("ty"))
    cells = tiled.groupBy("tx", "ty").applyInPandas(run, "bx int, by int, raw double, nx double, ny double")
    strength = F.col("raw") / F.col("top")
    kept = cells.join(F.broadcast(cells.agg(F.max("raw").alias("top")))).where(strength >= min_strength_bp / 10_000)  # one row
    tx, ty = -F.col("ny"), F.col("nx")
    sign = F.when((tx < 0) | ((tx == 0) & (ty < 0)), -1.0).otherwise(1.0)
    return kept.select("bx", "by", strength.cast("float").alias("strength"), (tx * sign).cast("float").alias("tangent_x"), (ty * sign).cast("float").alias("tangent_y"))
