"""Categories: dictionaries, at most eight layers, and the composition of cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import is_blank, trim_ws

MAX_LAYERS = 8
OTHER, MISSING, INVALID = "Other", "Missing", "Invalid"


def category_text(c: Column, kind: T.DataType) -> Column:
    """Trimmed text of a category; null when missing."""
    text = trim_ws(c) if isinstance(kind, T.StringType) else c.cast("string")
    return F.when(~is_blank(c), text)


def category_index(df: DataFrame, column: str, budget: int, valid: Column | None = None) -> DataFrame:
    """(value_id, value, n, truncated): the dictionary, ids in order of value, with exact counts.

    Beyond ``budget`` distinct values the most frequent are kept (ties: the
    smaller value) and ``truncated`` is true.  Only counts reach the window.
    """
    kind = df.schema[column].dataType
    value = category_text(F.col(column), kind)
    rows = df.where(value.isNotNull() & (F.lit(True) if valid is None else valid))
    counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(budget + 1)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    cut = ranked.withColumn("truncated", F.max("r").over(Window.partitionBy()) > budget).where(F.col("r") <= budget)
    return cut.select((F.row_number().over(Window.orderBy("value")) - 1).alias("value_id"), "value", "n", "truncated")


@dataclass(frozen=True)
class Layer:
    layer: int
    label: str
    kind: str  #: value, other, missing or invalid
    n: int


@dataclass(frozen=True)
class LayerPlan:
    """Layers in order; ``omitted`` values with rows have no layer of their own."""

    layers: tuple[Layer, ...]
    omitted: int

    def layer_of(self, value: Column, invalid: Column | None = None) -> Column:
        """Layer number of a category text (null: missing)."""
        special = {x.kind: x.layer for x in self.layers if x.kind != "value"}
        own = {x.label: x.layer for x in self.layers if x.kind == "value"}
        out = F.lit(special.get("other"))
        for label, layer in own.items():
            out = F.when(value == label, F.lit(layer)).otherwise(out)
        out = F.when(value.isNull(), F.lit(special.get("missing"))).otherwise(out)
        if invalid is not None:
            out = F.when(invalid, F.lit(special.get("invalid"))).otherwise(out)
        return out.cast("int")


def plan_layers(df: DataFrame, column: str, selected: Sequence[str] = (), invalid: Column | None = None, budget: int = 4096) -> LayerPlan:
    """Up to eight layers: selected values first, then by count (ties: the smaller value), then Other, Missing and Invalid where needed.

    Only counts of at most eight values beyond the selected, and three totals,
    reach the driver.
    """
    kind = df.schema[column].dataType
    bad = F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False))
    value = category_text(F.col(column), kind)
    state = F.when(bad, "invalid").when(value.isNull(), "missing").otherwise("value")
    counts = df.groupBy(state.alias("state"), F.when(~bad, value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = counts.where("state = 'value'")
    totals = {r.state: (r.rows, r.kinds) for r in counts.groupBy("state").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds")).collect()}
    top = values.orderBy(F.desc("n"), "value").limit(MAX_LAYERS + len(selected)).collect()
    wanted = values.where(F.col("value").isin(list(selected))).collect() if selected else []
    n_of = {r.value: r.n for r in [*top, *wanted]}
    rows, distinct = totals.get("value", (0, 0))
    specials = [k for k in ("missing", "invalid") if k in totals]
    needs_other = distinct > MAX_LAYERS - len(specials)
    room = MAX_LAYERS - len(specials) - needs_other
    chosen = [v for v in dict.fromkeys(selected) if v in n_of][:room]
    chosen += [r.value for r in top if r.value not in chosen][: room - len(chosen)]
    named = [(v, "value", n_of[v]) for v in chosen]
    if needs_other:
        named.append((OTHER, "other", rows - sum(n_of[v] for v in chosen)))
    named += [({"missing": MISSING, "invalid": INVALID}[k], k, totals[k][0]) for k in specials]
    return LayerPlan(tuple(Layer(i, *x) for i, x in enumerate(named)), distinct - len(chosen))


def composition_grid(binned_df: DataFrame, layer: Column) -> DataFrame:
    """(bx, by, layer, n): one shuffle; every row needs a layer."""
    return binned_df.groupBy("bx", "by", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def composition_cells(grid: DataFrame, layers: int) -> DataFrame:
    """(bx, by, total, dominant_layer, dominant_share, entropy, purity) of each cell.

    Ties go to the lowest layer.  Entropy is relative to the plan's number of
    layers; with one layer it is 0.
    """
    cells = grid.groupBy("bx", "by").agg(
        F.sum("n").alias("total"),
        F.max(F.struct("n", (-F.col("layer")).alias("back"))).alias("top"),
        F.sum(F.col("n") * F.ln("n")).alias("nln"),
    )
    entropy = (F.ln("total") - F.col("nln") / F.col("total")) / float(_ln(layers)) if layers > 1 else F.lit(0.0)
    entropy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy))
    return cells.select("bx", "by", "total", (-F.col("top.back")).alias("dominant_layer"), (F.col("top.n") / F.col("total")).alias("dominant_share"), entropy.alias("entropy")).withColumn("purity", 1.0 - F.col("entropy"))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def composition_mismatch(grid: DataFrame, density: DataFrame) -> DataFrame:
    """Cells where the layers' counts do not add up to the density; empty when the invariant holds."""
    sums = grid.groupBy("bx", "by").agg(F.sum("n").alias("layers_n"))
    both = sums.join(density, ["bx", "by"], "full_outer")
    return both.where(~F.col("layers_n").eqNullSafe(F.col("n"))).select("bx", "by", "layers_n", "n")


def inspect_cells(grid: DataFrame, plan: LayerPlan) -> DataFrame:
    """(bx, by, total, layers): for each cell the labelled layers with counts and shares, in layer order."""
    labels = F.array(*[F.lit(x.label) for x in plan.layers])
    total = grid.groupBy("bx", "by").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("layer", "n"))).alias("parts"))
    shown = F.transform("parts", lambda p: F.struct(p["layer"].alias("layer"), F.element_at(labels, p["layer"] + 1).alias("label"), p["n"].alias("n"), (p["n"] / F.col("total")).alias("share")))
    return total.select("bx", "by", "total", shown.alias("layers"))
