"""Density ridges on whole arrays: the plain form that the Spark operator is held against."""

import numpy as np

from fieldglass.operators.ridges import KERNELS, TINY, VARIANCE


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


def _bilinear(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between cells; coordinates are held to the grid."""
    h, w = v.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = x - x0, y - y0
    top = v[y0, x0] + (v[y0, x1] - v[y0, x0]) * tx
    low = v[y1, x0] + (v[y1, x1] - v[y1, x0]) * tx
    return top + (low - top) * ty


def ridge_field(counts: np.ndarray, scale: str = "medium", min_strength_bp: int = 250, min_anisotropy_bp: int = 1_500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strength, tangent_x, tangent_y) of each cell as 32-bit floats; 0 where there is no ridge.

    A ridge cell has a negative smaller Hessian eigenvalue, enough anisotropy,
    and is not below its neighbours along that eigenvector, and above one.
    Strength is relative to the strongest cell; tangents point to +x, or +y
    where they are vertical.
    """
    if scale not in KERNELS or not (0 <= min_strength_bp <= 10_000 and 0 <= min_anisotropy_bp <= 10_000):
        raise ValueError("unknown scale or basis points beyond 10000")
    v = smooth(counts, scale)
    h, w = v.shape
    p = np.pad(v, 1, mode="edge")
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    sx, sy = 1.0 / max(1, w - 1), 1.0 / max(1, h - 1)
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
    gy, gx = np.mgrid[0:h, 0:w].astype(float)
    plus, minus = _bilinear(v, gx + nx, gy + ny), _bilinear(v, gx - nx, gy - ny)
    crest = has & (v >= plus) & (v >= minus) & ((v > plus) | (v > minus))
    gap = np.abs(high - low)
    anisotropy = gap / (np.abs(high) + np.abs(low) + TINY)
    ridge = crest & (low < 0) & (anisotropy >= min_anisotropy_bp / 10_000) & (gap > TINY)
    raw = np.where(ridge, VARIANCE[scale] * np.maximum(-low, 0.0), 0.0)
    top = raw.max(initial=0.0)
    strength = np.clip(raw / top, 0, 1) if top > 0 else raw
    keep = (strength > 0) & (strength >= min_strength_bp / 10_000)
    tx, ty = -ny, nx
    flip = (tx < 0) | ((tx == 0) & (ty < 0))
    tx, ty = np.where(flip, -tx, tx), np.where(flip, -ty, ty)
    return tuple(np.where(keep, a, 0.0).astype(np.float32) for a in (strength, tx, ty))
