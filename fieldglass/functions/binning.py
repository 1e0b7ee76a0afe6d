"""Bins: closed outer edges, half-open inner ones, values outside dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grids larger than this are refused before a job is started.
MAX_BINS = 16_777_216
MAX_FIELD_BINS = 4 * 1024 * 1024


def check_bins(width: int, height: int = 1) -> None:
    if width < 1 or height < 1 or width * height > MAX_BINS:
        raise ValueError(f"a grid needs 1 to {MAX_BINS} bins, got {width} x {height}")


def check_domain(lo: float, hi: float) -> None:
    if not (float("-inf") < lo < hi < float("inf")):
        raise ValueError(f"a domain needs finite, increasing bounds, got {lo}..{hi}")


def bin_float(v: Column, lo: Column | float, hi: Column | float, bins: int) -> Column:
    """Bin of a double in [lo, hi]; hi itself falls in the last bin, values outside are null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    at = F.floor((v - lo) / (hi - lo) * bins).cast("int")
    return F.when((v >= lo) & (v <= hi), F.least(at, F.lit(bins - 1)))


def bin_integer(v: Column, lo: int, hi: int, bins: int) -> Column:
    """Exact bin of an integer in [lo, hi]: floor(offset * bins / span), at most bins - 1.

    Long arithmetic where the product fits 63 bits, decimals beyond.  A domain
    of one value has one bin, 0.
    """
    kind = "long" if (hi - lo) * bins < 2**63 and -(2**63) <= lo and hi < 2**63 else "decimal(38,0)"
    if hi == lo:
        return F.when(v == _int(lo, kind), F.lit(0))
    at = _div((v.cast(kind) - _int(lo, kind)) * _int(bins, kind), _int(hi - lo, kind))
    return F.when((v >= _int(lo, kind)) & (v <= _int(hi, kind)), F.least(at.cast("int"), F.lit(bins - 1)))


def _int(n: int, kind: str) -> Column:
    return F.expr(f"cast('{n}' as {kind})")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def bin_lane(lane: Column, lanes: int, height: int) -> Column:
    """Bin of a lane: lane * height div lanes; lanes outside are null."""
    at = _div(lane.cast("long") * F.lit(height).cast("long"), F.lit(lanes).cast("long"))
    return F.when((lane >= 0) & (lane < lanes), F.least(at.cast("int"), F.lit(height - 1)))


def row_bucket(row_id: Column, rows: Column | int, buckets: int) -> Column:
    """Bucket b of the rows [b * n div k, (b + 1) * n div k): the inverse of those boundaries."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return _div((row_id + 1) * F.lit(buckets).cast("long") - 1, rows.cast("long")).cast("int")


def bin_bounds(lo: Column | float, hi: Column | float, index: Column, bins: int) -> tuple[Column, Column]:
    """Edges of a bin; the last edge is the domain's end exactly."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    span = hi - lo
    return lo + index * span / bins, F.when(index + 1 == bins, hi).otherwise(lo + (index + 1) * span / bins)


def widen_domain(lo: float, hi: float) -> tuple[float, float]:
    """A single value becomes a domain around it: 1 per cent to either side, 1 at least."""
    if lo != hi:
        return lo, hi
    by = max(1.0, abs(lo) * 0.01)
    return lo - by, hi + by


F32_EPSILON = 2.0**-23


def widen_display_f32(lo: float, hi: float) -> tuple[float, float]:
    """A single value becomes a domain one 32-bit epsilon wide to either side, relative above 1."""
    if lo != hi:
        return lo, hi
    by = max(F32_EPSILON, abs(lo) * F32_EPSILON)
    return lo - by, hi + by


def widen_display_u64(lo: int, hi: int) -> tuple[int, int]:
    """A single unsigned value becomes a domain of one to either side; at an end of the type that is an error."""
    if lo != hi:
        return lo, hi
    if lo == 0 or hi == 2**64 - 1:
        raise ValueError("a single value at the end of its type cannot be widened")
    return lo - 1, hi + 1


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, in any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def time_fraction(us: Column, lo: int, hi: int) -> Column:
    """Place of a time in [lo, hi] as 0..1, clamped; one half in an empty span."""
    if lo == hi:
        return F.when(us.isNotNull(), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (us - lo).cast("double") / float(hi - lo)))


def time_at(fraction: Column, lo: int, hi: int) -> Column:
    """Microseconds at a place, rounded to the nearest."""
    return (F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * float(hi - lo)) + lo).cast("long")


def time_span(first: float, last: float, lo: int, hi: int) -> tuple[int, int]:
    """Microseconds that cover the places first..last, rounded outwards."""
    import math

    a, b = (min(1.0, max(0.0, x)) * (hi - lo) for x in sorted((first, last)))
    return lo + math.floor(a), lo + math.ceil(b)
