"""A visual query: fields, filters, domain, grid and mode, compiled to a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import category, comparison, contours, fields, ridges
from ..operators.filters import Cohort, in_box
from ..operators.projection import Extent, Mapping, extent, project


@dataclass(frozen=True)
class VisualQuery:
    """What to bind, whom to include, and which field to compute.

    ``domain`` (x0, x1, y0, y1) is the view; None takes the extent of all rows.
    """

    mapping: Mapping
    mode: str = "density"
    cohort: Cohort = field(default_factory=Cohort)
    width: int = 512
    height: int = 512
    domain: tuple[float, float, float, float] | None = None
    layers: tuple[str, ...] = ()
    scale: str = "medium"

    def over(self, df: DataFrame) -> BoundQuery:
        """Bind to a table: checks columns and mode, and finds the domain if none is given."""
        self.mapping.validate(df.schema)
        if not self.mapping.supports(self.mode):
            raise ValueError(f"mode {self.mode!r} needs a category")
        rows = project(self.cohort.apply(df), self.mapping)
        if self.domain is not None:
            return BoundQuery(self, rows, self.domain)
        e: Extent = extent(rows).widened()
        return BoundQuery(self, rows, (e.x0, e.x1, e.y0, e.y1))

    def zoomed(self, domain: tuple[float, float, float, float]) -> VisualQuery:
        return replace(self, domain=domain)


@dataclass(frozen=True)
class BoundQuery:
    query: VisualQuery
    rows: DataFrame  #: with included, px and py
    domain: tuple[float, float, float, float]

    def binned(self, cohort_only: bool = True) -> DataFrame:
        rows = self.rows.where("included") if cohort_only else self.rows
        return fields.binned(rows, F.col("px"), F.col("py"), self.domain, self.query.width, self.query.height)

    def grid(self) -> DataFrame:
        return fields.density(self.binned())

    def field(self) -> DataFrame:
        """The field of the query's mode."""
        q = self.query
        if q.mode == "density":
            return self.grid()
        if q.mode == "ridges":
            return ridges.density_ridges(self.grid(), q.width, q.height, q.scale)
        if q.mode == "comparison":
            totals = comparison.cohort_totals(self.rows)
            return comparison.with_visibility(comparison.difference_grid(self.binned(False), totals))
        plan = self.layer_plan()
        kind = self.rows.schema[q.mapping.category].dataType
        layer = plan.layer_of(category.category_text(F.col(q.mapping.category), kind))
        return category.composition_grid(self.binned(), layer)

    def layer_plan(self) -> category.LayerPlan:
        return category.plan_layers(self.rows.where("included"), self.query.mapping.category, self.query.layers)

    def settled(self, basis_points: tuple[int, ...] = (5_000, 8_000, 9_500)) -> dict[str, DataFrame]:
        """Counts, contours and marginals of one cached grid."""
        grid = self.grid().cache()
        return {"counts": grid, "contours": contours.mass_contours(grid, basis_points), "marginals": fields.marginals(grid)}

    def selected(self, box: tuple[float, float, float, float]) -> DataFrame:
        """The included rows in a brush box."""
        return self.rows.where(F.col("included") & in_box(F.col("px"), F.col("py"), box))
