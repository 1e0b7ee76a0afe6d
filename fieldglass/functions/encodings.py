"""Scalar encodings of counts and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def density_intensity(n: Column, most: Column, transform: str = "log") -> Column:
    """Count as 0..1 of the largest, linear or log1p, as a 32-bit float; 0 where the largest is 0."""
    if transform not in ("linear", "log"):
        raise ValueError(f"unknown transform {transform!r}")
    value = n / most if transform == "linear" else F.ln(n + 1.0) / F.ln(most + 1.0)
    return F.when((most > 0) & (n > 0), F.least(F.lit(1.0), value)).otherwise(0.0).cast("float")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def fixed_abs_delta(d: Column) -> Column:
    """|d| in billionths, rounded, at most the largest 32-bit value."""
    return F.least(F.round(F.abs(d) * 1e9).cast("long"), F.lit(4_294_967_295))


def split_share(count: Column, total: Column) -> Column:
    """A share as the sum of two 32-bit floats, struct(high, low)."""
    share = safe_ratio(count.cast("double"), total)
    high = share.cast("float")
    return F.struct(high.alias("high"), (share - high.cast("double")).cast("float").alias("low"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def support_aware(delta: Column, support: Column, max_abs_delta: Column, max_support: Column) -> Column:
    """struct(normalized_delta in [-1, 1], support_visibility in [0, 1]); 0 where the maximum is 0."""
    d = F.when(max_abs_delta > 0, clamp(delta / max_abs_delta, -1.0, 1.0)).otherwise(0.0)
    s = F.when(max_support > 0, clamp(support / max_support, 0.0, 1.0)).otherwise(0.0)
    return F.struct(d.alias("normalized_delta"), s.alias("support_visibility"))


def split_sample(baseline: Column, active: Column, fraction: Column, split: float) -> Column:
    """The baseline left of the split, the active value from it on."""
    return F.when(fraction < split, baseline).otherwise(active)


def composition_rgba(total: Column, purity: Column, dominant_rgb: tuple[Column, Column, Column], neutral: tuple[float, float, float], most: Column, floor: float = 0.2, opacity: float = 1.0) -> Column:
    """Linear colour of a cell: toward neutral by impurity, lighter with the square root of density."""
    ratio = F.least(F.lit(1.0), total / most)
    light = floor + (1.0 - floor) * F.sqrt(ratio)
    rgb = [(n + (d - n) * purity) * light for d, n in zip(dominant_rgb, neutral, strict=True)]
    return F.when(total > 0, F.array(*rgb, opacity * ratio)).otherwise(F.array(*[F.lit(float(n)) for n in neutral], F.lit(0.0)))


def semantic_zoom(rows_per_pixel: Column, points_below: float = 0.02, density_above: float = 0.12) -> Column:
    """struct(density_alpha, point_alpha): points fade in as rows a pixel fall from ``density_above`` to ``points_below``."""
    if not 0 <= points_below < density_above < float("inf"):
        raise ValueError("thresholds must be finite, non-negative and increasing")
    alpha = clamp((density_above - rows_per_pixel) / (density_above - points_below), 0.0, 1.0)
    alpha = F.when(rows_per_pixel.isNull() | F.isnan(rows_per_pixel) | (F.abs(rows_per_pixel) == float("inf")), 0.0).otherwise(alpha)
    return F.struct(clamp(1.0 - alpha * 0.88, 0.12, 1.0).alias("density_alpha"), alpha.alias("point_alpha"))


def plot_fraction(v: Column, lo: float, hi: float) -> Column:
    """Place of a value in its domain, null outside."""
    return F.when((v >= lo) & (v <= hi), (v - lo) / (hi - lo))


def packed_coordinate(v: Column, lo: float, hi: float) -> Column:
    """A coordinate as a 32-bit fraction of its domain; null outside it."""
    return plot_fraction(v, lo, hi).cast("float")
