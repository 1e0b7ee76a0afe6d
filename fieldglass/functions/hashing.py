"""SplitMix64 as Column arithmetic.

ANSI mode raises on 64-bit overflow, so sums and products are built from
16-bit limbs, which cannot overflow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published constants of SplitMix64.
GAMMA = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK = 2**64 - 1


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: expression trees would otherwise double at every use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]


def _join(limbs: list[Column]) -> Column:
    """Carry, then put four limbs together; bits over 64 are dropped."""
    carry, out = F.lit(0).cast("long"), []
    for i, limb in enumerate(limbs):
        total = limb + carry
        out.append(F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * i))
        carry = F.shiftright(total, 16)
    return reduce(lambda a, b: a.bitwiseOR(b), out)


def wrap_add(x: Column, constant: int) -> Column:
    """x + constant modulo 2^64."""
    return _let(x, lambda v: _sum(v, constant))


def _sum(v: Column, constant: int) -> Column:
    return _join([a + ((constant >> (16 * i)) & 0xFFFF) for i, a in enumerate(_limbs(v))])


def wrap_mul(x: Column, constant: int) -> Column:
    """x * constant modulo 2^64."""
    return _let(x, lambda v: _product(v, constant))


def _product(v: Column, constant: int) -> Column:
    a, b = _limbs(v), [(constant >> (16 * i)) & 0xFFFF for i in range(4)]
    return _join([reduce(lambda p, q: p + q, [a[j] * F.lit(b[i - j]).cast("long") for j in range(i + 1)]) for i in range(4)])


def _xor_shift(x: Column, n: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))


def splitmix64(state: Column) -> Column:
    """The output for a state that has already been advanced; a signed long with the bits of the unsigned value."""
    z = wrap_mul(_xor_shift(state, 30), MIX[0])
    z = wrap_mul(_xor_shift(z, 27), MIX[1])
    return _xor_shift(z, 31)


def stable_priority(row_id: Column) -> Column:
    """Pseudo-random priority of a row, the same on every run."""
    return splitmix64(wrap_add(row_id.cast("long"), GAMMA))


def unsigned_order(x: Column) -> Column:
    """A long that sorts as the unsigned value of ``x``."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def draw(seed: int, index: Column) -> Column:
    """Output number ``index`` (from 0) of a generator with ``seed``: its state is seed + (index + 1) * gamma, so draws need no order."""
    return splitmix64(wrap_add(wrap_mul(index.cast("long") + 1, GAMMA), seed & MASK))


def with_splitmix64(df: DataFrame, states: dict[str, Column]) -> DataFrame:
    """Add SplitMix64 outputs of several states, step by step as columns, so that each step is compiled code over plain columns.

    The Column forms above bind their steps in lambdas, which Spark interprets;
    use this form to sort many rows.  Do not filter on the result: the
    optimiser would put every step into the condition, several times over.
    """
    out = df.withColumns(states)
    names = list(states)
    shift = lambda n, by: F.col(n).bitwiseXOR(F.shiftrightunsigned(n, by))
    for by, factor in ((30, MIX[0]), (27, MIX[1])):
        out = out.withColumns({n: shift(n, by) for n in names})
        out = out.withColumns({n: _product(F.col(n), factor) for n in names})
    return out.withColumns({n: shift(n, 31) for n in names})


def with_priority(df: DataFrame, row_id: str, name: str) -> DataFrame:
    """Add :func:`stable_priority` of a row id, in an order that sorts as the unsigned value."""
    out = with_splitmix64(df, {name: _sum(F.col(row_id).cast("long"), GAMMA)})
    return out.withColumn(name, unsigned_order(F.col(name)))


def below(x: Column, n: int) -> Column:
    """Unsigned x modulo n, for n under 2^31: taken limb by limb from the top."""

    rest = F.lit(0).cast("long")
    for limb in reversed(_limbs(x)):
        rest = (rest * F.lit(1 << 16).cast("long") + limb) % F.lit(n).cast("long")
    return rest


# -- the same generator over arrays, for tables that are made rather than read --------------------


def array_draws(seed: int, index: np.ndarray) -> np.ndarray:
    """:func:`draw` for an array of indices, as unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        z = (index.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA) + np.uint64(seed & MASK)
        for by, factor in ((30, MIX[0]), (27, MIX[1])):
            z = (z ^ (z >> np.uint64(by))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def array_unit(x: np.ndarray) -> np.ndarray:
    """The top 24 bits as 32-bit floats in [0, 1)."""
    return (x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
