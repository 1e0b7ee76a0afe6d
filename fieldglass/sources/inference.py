"""Column kinds of text tables, as a lattice folded by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell, is_blank, parse_float, parse_integer

KINDS = ("Empty", "Integer", "Float", "String")


def rank(c: Column) -> Column:
    """Place in the lattice: 0 blank, 1 integer, 2 finite float, 3 other text."""
    return F.when(is_blank(c), 0).when(parse_integer(c).isNotNull(), 1).when(parse_float(c).isNotNull(), 2).otherwise(3)


def infer_frame(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind): the lattice's join is a maximum, so all columns fold in one aggregate."""
    columns = list(columns or df.columns)
    top = df.agg(*[F.coalesce(F.max(rank(F.col(c).cast("string"))), F.lit(0)).alias(f"r{i}") for i, c in enumerate(columns)])
    names = F.array(*[F.lit(k) for k in KINDS])
    return top.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.element_at(names, F.col(f"r{i}") + 1).alias("kind")) for i, c in enumerate(columns)])))


def infer_kinds(df: DataFrame) -> dict[str, str]:
    return {r.column: r.kind for r in infer_frame(df).collect()}


def store_types(df: DataFrame, kinds: dict[str, str]) -> dict[str, str]:
    """Storage type of each column: bigint, or decimal(20,0) where an integer needs unsigned 64 bits; double; string."""
    integers = [c for c, k in kinds.items() if k == "Integer"]
    wide = df.agg(F.lit(0).alias("z"), *[F.coalesce(F.max(parse_integer(F.col(c)) > F.lit(2**63 - 1)), F.lit(False)).alias(f"w{i}") for i, c in enumerate(integers)]).first()
    unsigned = {c for i, c in enumerate(integers) if wide[f"w{i}"]}
    return {c: "decimal(20,0)" if c in unsigned else {"Integer": "bigint", "Float": "double"}.get(k, "string") for c, k in kinds.items()}


def decode(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Each column as struct(raw, value, state): one projection, raw spelling kept."""
    out = {}
    for c, t in types.items():
        text = F.col(c).cast("string")
        value = {"bigint": lambda x: parse_integer(x).try_cast("bigint"), "decimal(20,0)": parse_integer, "double": parse_float}.get(t, lambda x: x)(text)
        out[c] = cell(F.col(c), value, df.schema[c].dataType)
    return df.withColumns(out)
