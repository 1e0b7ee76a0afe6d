import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import catalog, category, comparison, contours, diff, fields, intervals, missingness, projection, reveal, ridges, selection
from fieldglass.operators.filters import CategorySet, Cohort, FilterSet, NumericRange
from fieldglass.plans.query import VisualQuery

from .ridge_arrays import ridge_field


def grid_of(spark, counts):
    rows = [(x, y, int(n)) for y, line in enumerate(counts) for x, n in enumerate(line)]
    return spark.createDataFrame(rows, "bx int, by int, n long")


@pytest.fixture
def games(spark):
    rows = [("1200", "white"), ("1800", "black"), ("", "white"), ("bad", "")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, rating string, winner string")


def included(df, *filters, policy="exclude"):
    fs = FilterSet()
    for f in filters:
        fs = fs.put(f)
    return [r.included for r in Cohort(fs, policy).apply(df).orderBy("row_id").collect()]


def test_filters(games):
    assert included(games, NumericRange("rating", 1000, 1500), CategorySet("winner", ("white",))) == [True, False, False, False]
    kind = games.schema["rating"].dataType
    got = [r[0] for r in games.orderBy("row_id").select(NumericRange("rating", 1000, 1300, True).condition(kind)).collect()]
    assert got == [True, False, True, True]
    assert included(games, CategorySet("winner", ())) == [False] * 4
    assert included(games) == [True] * 4
    s = Cohort(FilterSet().put(NumericRange("rating", 1000, 1500))).stats(games).first()
    assert tuple(s) == (4, 1, 1, 1)
    with pytest.raises(ValueError, match="rating"):
        Cohort(FilterSet().put(NumericRange("rating", 0, 1)), "reject").apply(games)
    with pytest.raises(ValueError):
        NumericRange("rating", 5, 1)
    with pytest.raises(ValueError):
        included(games, NumericRange("nope", 0, 1))


def test_filter_set_revisions():
    f = NumericRange("a", 0, 1)
    s = FilterSet().put(f)
    assert s.put(f) is s and s.revision == 1
    assert s.put(NumericRange("a", 0, 2)).revision == 2 and len(s.put(NumericRange("a", 0, 2)).filters) == 1
    assert s.remove("b") is s and s.clear().filters == () and FilterSet().clear().revision == 0


def test_nan_is_outside_ranges(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 5.0), (2, None)], "row_id long, v double")
    assert included(df, NumericRange("v", 1, 9)) == [False, True, False]


def test_density_and_overview(spark):
    df = spark.createDataFrame([(0, 1.5, 1.5), (1, 50.0, 1.0), (2, 1.2, 1.9)], "row_id long, x double, y double")
    b = fields.binned(df, F.col("x"), F.col("y"), (0.0, 10.0, 0.0, 10.0), 10, 10)
    assert [tuple(r) for r in fields.density(b).collect()] == [(1, 1, 2)]
    assert [tuple(r) for r in fields.overview(b, "row_id", 1).collect()] == [(1, 1, 2, [0])]
    dense = fields.dense_counts(fields.density(b), 10, 10).first()
    assert sum(dense.counts) == 2 and dense.counts[11] == 2 and dense.max_count == 2
    assert fields.densify(fields.density(b.limit(0)), 3, 2).agg(F.sum("n")).first()[0] == 0


def test_mass_contours(spark):
    g = grid_of(spark, [[5, 5], [2, 1]])
    got = {r.basis_points: (r.threshold, r.enclosed) for r in contours.mass_contours(g, (5_000, 9_000, 10_000)).collect()}
    assert got == {5_000: (5, 10), 9_000: (2, 12), 10_000: (1, 13)}
    assert contours.mass_contours(grid_of(spark, [[0, 0]]), (5_000,)).count() == 0
    with pytest.raises(ValueError):
        contours.mass_contours(g, (0,))
    m = {(r.axis, r.bin): r.n for r in fields.marginals(grid_of(spark, [[1, 2, 3], [4, 5, 6]])).collect()}
    assert [m["x", i] for i in range(3)] == [5, 7, 9] and [m["y", i] for i in range(2)] == [6, 15]


def test_neighbourhood(spark):
    c = np.arange(12).reshape(3, 4)
    got = {(r.bx, r["by"]): r.around for r in contours.neighbourhood(grid_of(spark, c), 4, 3).collect()}
    p = np.pad(c, 1)
    assert all(got[x, y] == p[y : y + 3, x : x + 3].sum() for x in range(4) for y in range(3))


def _ridge_by_loops(counts, scale):
    """The definition cell by cell."""
    k = np.array({"fine": [1, 2, 1], "medium": [1, 4, 6, 4, 1]}[scale], float)
    k /= k.sum()
    r, (h, w) = len(k) // 2, counts.shape
    hor = np.array([[sum(k[i] * counts[y, min(max(x + i - r, 0), w - 1)] for i in range(len(k))) for x in range(w)] for y in range(h)])
    v = np.array([[sum(k[i] * hor[min(max(y + i - r, 0), h - 1), x] for i in range(len(k))) for x in range(w)] for y in range(h)])
    at = lambda y, x: v[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            dxx = (at(y, x + 1) - 2 * v[y, x] + at(y, x - 1)) * (w - 1) ** 2
            dyy = (at(y + 1, x) - 2 * v[y, x] + at(y - 1, x)) * (h - 1) ** 2
            dxy = (at(y + 1, x + 1) - at(y + 1, x - 1) - at(y - 1, x + 1) + at(y - 1, x - 1)) / 4 * (w - 1) * (h - 1)
            low = np.linalg.eigvalsh([[dxx, dxy], [dxy, dyy]])[0]
            out[y, x] = low
    return out


def test_ridges(spark, monkeypatch):
    monkeypatch.setattr(ridges, "TILE", 4)  # tiles smaller than the grids
    flat = np.full((9, 9), 3)
    assert not ridge_field(flat)[0].any() and not ridge_field(np.zeros((4, 4)))[0].any()
    band = np.zeros((9, 11))
    band[4, :] = 10
    s, tx, ty = ridge_field(band)
    assert (s[4] > 0.9).all() and not s[:4].any() and np.allclose(tx[4], 1) and np.allclose(ty[4], 0)
    diagonal = np.eye(15) * 8
    s, tx, ty = ridge_field(diagonal)
    assert s[7, 7] > 0 and abs(tx[7, 7] - ty[7, 7]) < 1e-6
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 20, (8, 10))
    s, _, _ = ridge_field(noise, "medium", 0, 0)
    low = _ridge_by_loops(noise, "medium")
    on = s > 0
    assert np.allclose(s[on], (-low[on]) / (-low[on]).max(), atol=1e-5)
    got = ridges.density_ridges(grid_of(spark, band), 11, 9).collect()
    assert {(r.bx, r["by"]) for r in got} == {(x, 4) for x in range(11)}
    assert ridges.density_ridges(grid_of(spark, np.zeros((4, 4), int)), 4, 4).count() == 0
    big = rng.integers(0, 9, (600, 530)) * (rng.random((600, 530)) < 0.3)
    for scale, counts in (("medium", noise), ("fine", diagonal.astype(int)), ("coarse", noise.T), ("medium", big)):
        if counts is big:
            monkeypatch.setattr(ridges, "TILE", 512)
        h, w = counts.shape
        s, tx, ty = ridge_field(counts, scale)
        got = {(r.bx, r["by"]): (r.strength, r.tangent_x, r.tangent_y) for r in ridges.density_ridges(grid_of(spark, counts), w, h, scale).collect()}
        want = {(x, y): (s[y, x], tx[y, x], ty[y, x]) for y, x in zip(*np.nonzero(s), strict=True)}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_composition(spark):
    rows = [(0, 0, i, n) for i, n in enumerate([4, 2, 1, 0]) if n]
    g = spark.createDataFrame(rows, "bx int, by int, layer int, n long")
    r = category.composition_cells(g, 4).first()
    p = np.array([4, 2, 1]) / 7
    assert r.dominant_layer == 0 and abs(r.entropy + (p * np.log(p)).sum() / np.log(4)) < 1e-9
    tie = spark.createDataFrame([(0, 0, 2, 3), (0, 0, 1, 3)], "bx int, by int, layer int, n long")
    assert category.composition_cells(tie, 3).first().dominant_layer == 1
    assert category.composition_cells(g, 1).first().purity == 1.0


def test_layer_plan(spark):
    values = [f"v{i}" for i in range(10) for _ in range(10 - i)] + [None, " "]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    plan = category.plan_layers(df, "c", selected=("v9",))
    assert [x.label for x in plan.layers] == ["v9", "v0", "v1", "v2", "v3", "v4", "Other", "Missing"]
    assert sum(x.n for x in plan.layers) == len(values) and plan.omitted == 4
    layer = {r.c: r.l for r in df.select("c", plan.layer_of(category.category_text(F.col("c"), df.schema["c"].dataType)).alias("l")).collect()}
    assert layer["v9"] == 0 and layer["v8"] == 6 and layer[None] == 7 and layer[" "] == 7
    few = category.plan_layers(df.where("c in ('v0', 'v1')"), "c")
    assert [x.kind for x in few.layers] == ["value", "value"] and few.omitted == 0


def test_difference(spark):
    rows = [(0, 0, i < 6) for i in range(10)] + [(1, 0, False)] * 10
    df = spark.createDataFrame(rows, "bx int, by int, included boolean")
    totals = comparison.cohort_totals(df)
    d = {r.bx: r for r in comparison.difference_grid(df, totals).collect()}
    assert totals == (20, 6) and d[0].signed_delta == 0.5 and d[1].signed_delta == -0.5
    with pytest.raises(ValueError):
        comparison.cohort_totals(df.where("false"))


def test_missingness(spark):
    rows = [(0, "", "x", ""), (1, "a", "", "c"), (2, "a", "b", ""), (3, "a", "b", "c")]
    df = spark.createDataFrame(rows, "row_id long, alpha string, beta string, gamma string")
    got = {(r.bucket, r.column): (r.missing, r.total) for r in missingness.missingness_grid(df, "row_id", ["alpha", "beta", "gamma"], 2).collect()}
    assert got[0, "alpha"] == (1, 2) and got[0, "beta"] == (1, 2) and got[1, "gamma"] == (1, 2)
    s = missingness.missingness_selection(df, "row_id", ["alpha", "beta", "gamma"], 2, (0, 1), (0, 9)).first()
    assert s.row_ids == [0, 1] and s.missing == 3 and s.total == 6


def test_profiles_and_diff(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "a", "", None, "c"])], "row_id long, v string")
    p = catalog.column_profile(df, "v", "row_id", budget=2, leaders=2).first()
    assert (p.valid, p.missing, p.distinct, p.accuracy, p.leaders) == (4, 2, 3, "at_least", "a=2,b=1")
    a, b = df.schema, df.withColumn("w", F.lit(1)).schema
    assert [x[3] for x in diff.diff_by_ordinal(a, b)] == ["unchanged", "unchanged", "added"]
    empty = catalog.column_profile(df.limit(0), "v", "row_id").first()
    assert (empty.valid, empty.distinct, empty.accuracy) == (0, 0, "exact")


def test_selection_and_reveal(spark):
    df = spark.createDataFrame([(9, 10.0, 10.0, "a"), (2, 20.0, 20.0, "b"), (5, 30.0, 30.0, "b"), (7, 90.0, 90.0, "a")], "row_id long, x double, y double, kind string")
    sel = F.col("x") <= 50
    rows = selection.drilldown(df, sel, "row_id", ["row_id"], 2).collect()
    assert [r.row_id for r in rows] == [2, 5] and rows[0].sampled and rows[0].selected_rows == 3
    s = selection.scatter_summary(df, sel, "x", "y", "kind").first()
    assert s.selected_rows == 3 and s.top_kind == "b" and (s.x_min, s.x_max) == (10.0, 30.0)
    tie = selection.scatter_summary(df, F.lit(True), "x", "y", "kind").first()
    assert tie.top_kind == "b"
    few = [r.row_id for r in reveal.reveal_plan(df, F.col("x"), F.col("y"), (0, 50, 0, 50), "row_id", most=2).collect()]
    more = [r.row_id for r in reveal.reveal_plan(df, F.col("x"), F.col("y"), (0, 50, 0, 50), "row_id").collect()]
    assert set(few) < set(more) == {9, 2, 5}
    _, off = reveal.reveal_selection(df, F.col("x"), F.col("y"), (0, 50, 0, 50), "row_id", (100, 100), mode="off")
    assert off["blend"] == 0 and off["eligible"] == 3
    empty = selection.scatter_summary(df.limit(0), sel, "x", "y", "kind").first()
    assert empty.selected_percentage == 0 and empty.top_kind is None


def test_intervals(spark):
    t = spark.createDataFrame([(1, 5)], "start long, end long")
    a = spark.createDataFrame([(3, 6)], "start long, end long")
    got = {(r.family, r.start, r.end, r.side) for r in intervals.compare_intervals(t, a).collect()}
    assert got == {("overlap", 3, 5, None), ("residual", 1, 3, None), ("missing", 5, 6, None), ("symmetric_difference", 1, 3, "target"), ("symmetric_difference", 5, 6, "against")}
    assert {tuple(r) for r in intervals.coverage(t, a).collect()} == {(1, 3, 2, 0, 0.0), (3, 5, 2, 2, 1.0)}
    assert intervals.containment(t, a).first().status == "left_overhang"
    gap = spark.createDataFrame([(8, 9)], "start long, end long")
    assert ("gap", 6, 8) in {(r.family, r.start, r.end) for r in intervals.compare_intervals(t, a.union(gap)).collect()}
    nothing = t.limit(0)
    assert intervals.compare_intervals(nothing, nothing).count() == 0
    samples = spark.createDataFrame([(i,) for i in range(8)], "i long")
    states = [r.comparison_state for r in intervals.state_timeline(samples, "i", intervals.compare_intervals(t, a), check=True).orderBy("i").collect()]
    assert states == ["outside_anomaly", "missed_anomaly", "missed_anomaly", "detected_anomaly", "detected_anomaly", "false_positive", "outside_anomaly", "outside_anomaly"]
    runs = intervals.contiguous_ranges(spark.createDataFrame([(i, i in (1, 2, 5)) for i in range(7)], "i long, a boolean"), "i", F.col("a"))
    assert {tuple(r) for r in runs.collect()} == {(1, 3), (5, 6)}
    labels = spark.createDataFrame([("b", "c")], "start_ts string, end_ts string")
    series = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "ts string, i long")
    assert tuple(intervals.label_ranges(labels, series, "ts", "i").first()) == (1, 3)
    with pytest.raises(ValueError):
        intervals.label_ranges(labels, series.where("ts != 'c'"), "ts", "i").count()
    with pytest.raises(ValueError):
        intervals.aligned(series, series.where("i < 2"), "i", "ts")


def test_visual_query_modes(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), "abc"[i % 3]) for i in range(60)], "x double, y double, c string")
    m = projection.Mapping("x", "y", category="c")
    counts = {}
    for mode in projection.MODES:
        q = VisualQuery(m, mode, Cohort(FilterSet().put(NumericRange("x", 0, 3))), 8, 6)
        counts[mode] = q.over(df).field().count()
    assert counts["density"] > 0 and counts["composition"] >= counts["density"] and counts["comparison"] > 0
    with pytest.raises(ValueError):
        VisualQuery(projection.Mapping("x", "y"), "composition").over(df)
    with pytest.raises(ValueError):
        projection.Mapping("x", "x").validate(df.schema)
    with pytest.raises(ValueError):
        projection.Mapping("c", "y").validate(df.schema)
    settled = VisualQuery(m, width=8, height=6).over(df).settled()
    assert settled["counts"].agg(F.sum("n")).first()[0] == 60 and settled["contours"].count() == 3
