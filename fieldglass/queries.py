"""Registered queries of the core library, each beside the SQL that checks it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import axes, binning, encodings, hashing
from .operators import catalog, category, comparison, contours, diff, fields, intervals, missingness, projection, reveal, ridges, selection
from .operators.filters import CategorySet, Cohort, FilterSet, NumericRange, first_invalid, in_box, in_time_brush
from .plans import evidence
from .plans.query import VisualQuery
from .sources import inference, keys, lanes, readers, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- grids over lineitem: quantity by price, 64 x 48 -------------------------------

W, H = 64, 48
_PAIR = projection.Mapping("l_quantity", "l_extendedprice")

#: Bin of a double; the same formula as the library's, over a CTE e(x0, x1, y0, y1).
_BX = f"CASE WHEN l_quantity >= x0 AND l_quantity <= x1 THEN least(CAST(floor((l_quantity - x0) / (x1 - x0) * {W}) AS INT), {W - 1}) END"
_BY = f"CASE WHEN l_extendedprice >= y0 AND l_extendedprice <= y1 THEN least(CAST(floor((l_extendedprice - y0) / (y1 - y0) * {H}) AS INT), {H - 1}) END"
_EXTENT = "e AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem)"
_VIEW = "e AS (SELECT 10.0::DOUBLE x0, 30.0::DOUBLE x1, 20000.0::DOUBLE y0, 60000.0::DOUBLE y1)"
_INC = "(l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'N'))"


def _binned_sql(extent: str = _EXTENT, where: str = "true") -> str:
    return f"WITH {extent}, b AS (SELECT {_BX} bx, {_BY} \"by\", {_INC} inc FROM lineitem, e WHERE {where}), g AS (SELECT bx, \"by\", count(*) n FROM b WHERE bx IS NOT NULL AND \"by\" IS NOT NULL GROUP BY 1, 2)"


_COHORT = Cohort(FilterSet().put(NumericRange("l_discount", 0.02, 0.06)).put(CategorySet("l_returnflag", ("A", "N"))))


def _query(cohort: Cohort | None = None, **more: object) -> VisualQuery:
    return VisualQuery(_PAIR, cohort=cohort or Cohort(), width=W, height=H, **more)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return _query().over(_t(spark, d, "lineitem")).grid()


@query(_binned_sql() + ' SELECT bx, "by", n FROM g')
def density_grid(spark, d):
    return _grid(spark, d)


@query(_binned_sql() + f', c AS (SELECT range cell, CAST(range % {W} AS INT) bx, CAST(range // {W} AS INT) "by" FROM range({W * H})) SELECT cell, bx, "by", coalesce(n, 0) n FROM c LEFT JOIN g USING (bx, "by")')
def density_grid_dense(spark, d):
    return fields.densify(_grid(spark, d), W, H)


@query(_binned_sql(where=_INC) + ' SELECT bx, "by", n FROM g')
def density_masked(spark, d):
    df = _t(spark, d, "lineitem")
    whole = _query().over(df)
    return _query(_COHORT, domain=whole.domain).over(df).grid()


@query(_binned_sql(_VIEW) + ' SELECT bx, "by", n FROM g')
def density_viewport(spark, d):
    return _query(domain=(10.0, 30.0, 20_000.0, 60_000.0)).over(_t(spark, d, "lineitem")).grid()


@query(_binned_sql() + ", m AS (SELECT max(n) m FROM g) SELECT bx, \"by\", round(CAST(ln(n + 1.0) / ln(m + 1.0) AS DOUBLE), 5) AS log_intensity, round(CAST(n AS DOUBLE) / m, 5) AS linear_intensity FROM g, m")
def density_intensity(spark, d):
    grid = _grid(spark, d).cache()
    most = F.lit(grid.agg(F.max("n")).first()[0])
    shown = lambda t: F.round(encodings.density_intensity(F.col("n"), most, t).cast("double"), 5)
    return grid.select("bx", "by", shown("log").alias("log_intensity"), shown("linear").alias("linear_intensity"))


@query(_binned_sql() + " SELECT 'x' AS axis, bx AS bin, CAST(sum(n) AS BIGINT) n FROM g GROUP BY bx UNION ALL SELECT 'y', \"by\", CAST(sum(n) AS BIGINT) FROM g GROUP BY \"by\"")
def scatter_marginals(spark, d):
    return fields.marginals(_grid(spark, d))


@query(_binned_sql() + ", s AS (SELECT 'x' AS axis, bx AS bin, sum(n) n FROM g GROUP BY bx UNION ALL SELECT 'y', \"by\", sum(n) FROM g GROUP BY \"by\") SELECT axis, count(*) bins, CAST(sum(n) AS BIGINT) total, CAST(max(n) AS BIGINT) max_n FROM s GROUP BY axis")
def grid_marginals_max(spark, d):
    return fields.marginal_maxima(_grid(spark, d))


@query(_binned_sql() + " SELECT n, count(*) bins FROM g GROUP BY n")
def bin_count_histogram(spark, d):
    return fields.bin_count_histogram(_grid(spark, d))


_BP = (2_500, 5_000, 8_000, 9_500)


@query(_binned_sql() + f", c AS (SELECT n, sum(n * k) OVER (ORDER BY n DESC) enclosed, sum(n * k) OVER () total FROM (SELECT n, count(*) k FROM g GROUP BY n)), w AS (SELECT unnest([{', '.join(map(str, _BP))}]) basis_points) SELECT CAST(basis_points AS INT) basis_points, max(n) threshold, CAST(min(enclosed) AS BIGINT) enclosed, CAST(max(total) AS BIGINT) total FROM c, w WHERE enclosed >= (total * basis_points + 9999) // 10000 GROUP BY basis_points")
def mass_contours(spark, d):
    return contours.mass_contours(_grid(spark, d), _BP)


@query(_binned_sql() + " SELECT DISTINCT n, round(cume_dist() OVER (ORDER BY n), 9) AS percentile FROM g")
def density_percentile(spark, d):
    return contours.density_percentile(_grid(spark, d)).select("n", F.round("percentile", 9).alias("percentile"))


@query(_binned_sql() + f', c AS (SELECT CAST(range % {W} AS INT) bx, CAST(range // {W} AS INT) "by" FROM range({W * H})), f AS (SELECT c.bx, c."by", coalesce(n, 0) n FROM c LEFT JOIN g USING (bx, "by")) SELECT a.bx, a."by", a.n, CAST(sum(b.n) AS BIGINT) around FROM f a JOIN f b ON abs(a.bx - b.bx) <= 1 AND abs(a."by" - b."by") <= 1 GROUP BY 1, 2, 3')
def neighborhood_3x3(spark, d):
    return contours.neighbourhood(_grid(spark, d), W, H)


_AT = ", ".join(f"max(vb.v) FILTER (dx = {x} AND dy = {y}) {'lch'[y + 1]}{'lch'[x + 1]}" for y in (-1, 0, 1) for x in (-1, 0, 1))
_SIDE = lambda nx, ny: "CASE WHEN {ny} < 0 THEN {l} + ({c} - {l}) * ({ny} + 1) ELSE {c} + ({h} - {c}) * {ny} END".format(
    ny=ny, **{y: f"(CASE WHEN {nx} < 0 THEN {y}l + ({y}c - {y}l) * ({nx} + 1) ELSE {y}c + ({y}h - {y}c) * {nx} END)" for y in "lch"}
)
_RIDGES = (
    _binned_sql()
    + f', f AS (SELECT CAST(range % {W} AS INT) bx, CAST(range // {W} AS INT) "by", coalesce(n, 0)::DOUBLE v FROM range({W * H}) LEFT JOIN g ON g.bx = range % {W} AND g."by" = range // {W})'
    + ", k AS (SELECT unnest([-2, -1, 0, 1, 2]) o, unnest([1, 4, 6, 4, 1])::DOUBLE / 16 k)"
    + f', hb AS (SELECT c.bx, c."by", sum(k * f.v) v FROM f c, k, f WHERE f."by" = c."by" AND f.bx = greatest(0, least({W - 1}, c.bx + o)) GROUP BY 1, 2)'
    + f', vb AS (SELECT c.bx, c."by", sum(k * hb.v) v FROM f c, k, hb WHERE hb.bx = c.bx AND hb."by" = greatest(0, least({H - 1}, c."by" + o)) GROUP BY 1, 2)'
    + f', p AS (SELECT c.bx, c."by", {_AT} FROM f c, (SELECT unnest([-1, 0, 1]) dx) x, (SELECT unnest([-1, 0, 1]) dy) y, vb WHERE vb.bx = greatest(0, least({W - 1}, c.bx + dx)) AND vb."by" = greatest(0, least({H - 1}, c."by" + dy)) GROUP BY 1, 2)'
    + f", s AS (SELECT 1::DOUBLE / {W - 1} sx, 1::DOUBLE / {H - 1} sy), h AS (SELECT p.*, (ch - cc * 2 + cl) / (sx * sx) xx, (hc - cc * 2 + lc) / (sy * sy) yy, (hh - hl - lh + ll) / (4 * sx * sy) xy FROM p, s)"
    + ", m AS (SELECT *, (xx + yy) / 2 mean, sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy) root FROM h), ev AS (SELECT *, mean - root low, mean + root high FROM m)"
    + ", l AS (SELECT *, CASE WHEN xy * xy + (low - xx) * (low - xx) >= (low - yy) * (low - yy) + xy * xy THEN xy ELSE low - yy END ax, CASE WHEN xy * xy + (low - xx) * (low - xx) >= (low - yy) * (low - yy) + xy * xy THEN low - xx ELSE xy END ay FROM ev)"
    + ", u AS (SELECT *, ax / sqrt(ax * ax + ay * ay) nx, ay / sqrt(ax * ax + ay * ay) ny FROM l WHERE root > 1e-12 AND sqrt(ax * ax + ay * ay) > 1e-12)"
    + f", z AS (SELECT *, {_SIDE('nx', 'ny')} plus, {_SIDE('(-nx)', '(-ny)')} minus FROM u)"
    + ", r AS (SELECT *, -low AS raw FROM z WHERE low < 0 AND abs(high - low) > 1e-12 AND abs(high - low) / (abs(high) + abs(low) + 1e-12) >= 0.15 AND cc >= plus AND cc >= minus AND (cc > plus OR cc > minus))"
    + ', t AS (SELECT bx, "by", raw / max(raw) OVER () AS strength, CASE WHEN -ny < 0 OR (ny = 0 AND nx < 0) THEN -1 ELSE 1 END AS sign, nx, ny FROM r)'
    + ' SELECT bx, "by", round(strength::FLOAT::DOUBLE, 5) AS strength, round((-ny * sign)::FLOAT::DOUBLE, 5) + 0 AS tangent_x, round((nx * sign)::FLOAT::DOUBLE, 5) + 0 AS tangent_y FROM t WHERE strength >= 0.025'
)


@query(_RIDGES)
def density_ridges(spark, d):
    out = ridges.density_ridges(_grid(spark, d), W, H)
    return out.select("bx", "by", *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in ("strength", "tangent_x", "tangent_y")])


@query(_binned_sql() + f" SELECT bx, round(CASE WHEN bx + 1 = {W} THEN x1 ELSE x0 + (bx + 1) * (x1 - x0) / {W} END, 6) AS x_end, round(x0 + bx * (x1 - x0) / {W}, 6) AS x_begin, CAST(sum(n) AS BIGINT) n FROM g, e GROUP BY bx, x0, x1")
def bin_bounds(spark, d):
    q = _query().over(_t(spark, d, "lineitem"))
    sums = q.grid().groupBy("bx").agg(F.sum("n").alias("n"))
    lo, hi = binning.bin_bounds(q.domain[0], q.domain[1], F.col("bx"), W)
    return sums.select("bx", F.round(lo, 6).alias("x_begin"), F.round(hi, 6).alias("x_end"), "n")


# -- comparison --------------------------------------------------------------------

_DIFF = _binned_sql() + f', t AS (SELECT count(*) tb, count(*) FILTER ({_INC}) ta FROM lineitem), d AS (SELECT bx, "by", count(*) baseline, count(*) FILTER (inc) active FROM b WHERE bx IS NOT NULL AND "by" IS NOT NULL GROUP BY 1, 2), s AS (SELECT bx, "by", baseline, active, baseline / tb::DOUBLE AS bs, active / ta::DOUBLE AS acs, active / ta::DOUBLE - baseline / tb::DOUBLE AS delta, (active / ta::DOUBLE + baseline / tb::DOUBLE) / 2 AS support FROM d, t)'


def _diff(spark: SparkSession, d: str) -> DataFrame:
    bound = _query(_COHORT).over(_t(spark, d, "lineitem"))
    return comparison.difference_grid(bound.binned(False), comparison.cohort_totals(bound.rows))


@query(_DIFF + ' SELECT bx, "by", baseline, active, round(bs, 12) AS baseline_share, round(acs, 12) AS active_share, round(delta, 12) AS signed_delta, round(support, 12) AS support_share FROM s')
def difference_grid(spark, d):
    r = lambda c: F.round(c, 12).alias(c)
    return _diff(spark, d).select("bx", "by", "baseline", "active", r("baseline_share"), r("active_share"), r("signed_delta"), r("support_share"))


@query(_DIFF + " SELECT CASE WHEN delta > 0 THEN 'over' WHEN delta < 0 THEN 'under' ELSE 'same' END AS direction, count(*) AS cells, CAST(sum(active) AS BIGINT) AS active FROM s GROUP BY 1")
def difference_direction(spark, d):
    return comparison.with_direction(_diff(spark, d)).groupBy("direction").agg(F.count(F.lit(1)).alias("cells"), F.sum("active").alias("active"))


@query(_DIFF + ', f AS (SELECT bx, "by", CAST(round(abs(delta) * 1e9) AS BIGINT) AS fixed FROM s), p AS (SELECT bx, "by", cume_dist() OVER (ORDER BY fixed) AS q FROM f WHERE fixed > 0) SELECT f.bx, f."by", f.fixed, round(q, 9) AS delta_percentile FROM f LEFT JOIN p USING (bx, "by")')
def difference_percentile(spark, d):
    out = comparison.with_delta_percentile(_diff(spark, d))
    return out.select("bx", "by", encodings.fixed_abs_delta(F.col("signed_delta")).alias("fixed"), F.round("delta_percentile", 9).alias("delta_percentile"))


@query(_DIFF + ', m AS (SELECT max(abs(delta)) md, max(support) ms FROM s) SELECT bx, "by", round(greatest(-1, least(1, delta / md)), 9) AS normalized_delta, round(greatest(0, least(1, support / ms)), 9) AS support_visibility FROM s, m')
def support_visibility(spark, d):
    out = comparison.with_visibility(_diff(spark, d))
    return out.select("bx", "by", F.round("normalized_delta", 9).alias("normalized_delta"), F.round("support_visibility", 9).alias("support_visibility"))


@query(_DIFF + ", m AS (SELECT 'x' AS axis, bx AS bin, sum(baseline) baseline, sum(active) active FROM s GROUP BY bx UNION ALL SELECT 'y', \"by\", sum(baseline), sum(active) FROM s GROUP BY \"by\") SELECT axis, bin, CAST(baseline AS BIGINT) baseline, CAST(active AS BIGINT) active, CAST(max(greatest(baseline, active)) OVER (PARTITION BY axis) AS BIGINT) shared_max FROM m")
def comparison_marginals(spark, d):
    return comparison.comparison_marginals(_diff(spark, d))


@query(_DIFF + f' SELECT bx, "by", round(CASE WHEN (bx + 0.5) / {W} < 0.5 THEN bs ELSE acs END, 12) AS shown_share FROM s')
def split_view(spark, d):
    at = (F.col("bx") + 0.5) / W
    return _diff(spark, d).select("bx", "by", F.round(encodings.split_sample(F.col("baseline_share"), F.col("active_share"), at, 0.5), 12).alias("shown_share"))


# -- timeline over events ------------------------------------------------------------

TW, TH = 48, 4
_LANES = "l AS (SELECT CAST(row_number() OVER (ORDER BY f, event_type) - 1 AS INT) lane, event_type, f FROM (SELECT event_type, min(event_id) f FROM events GROUP BY 1))"
_US = "epoch_us(ts)"
_EV = f"WITH {_LANES}, x AS (SELECT min({_US}) t0, max({_US}) t1 FROM events), c AS (SELECT count(*) lanes FROM l), v AS (SELECT event_id, user_id, value, {_US} us, lane, e.event_type, t0, t1, lanes FROM events e JOIN l USING (event_type), x, c), b AS (SELECT *, CAST(least(((us - t0) * {TW}) // (t1 - t0), {TW - 1}) AS INT) bx, CAST(least((lane * {TH}) // lanes, {TH - 1}) AS INT) \"by\" FROM v)"


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int], int]:
    df = _t(spark, d, "events").withColumn("us", binning.micros(F.col("ts")))
    dictionary = lanes.lane_dictionary(df, "event_type", "event_id")
    t0, t1 = df.agg(F.min("us"), F.max("us")).first()
    n = dictionary.count()
    return lanes.with_lane(df, dictionary, "event_type"), (t0, t1), n


@query(f"WITH {_LANES} SELECT lane, event_type AS label, f AS first_row FROM l")
def lane_dictionary(spark, d):
    return lanes.lane_dictionary(_t(spark, d, "events"), "event_type", "event_id")


@query(_EV + ' SELECT bx, "by", count(*) n FROM b GROUP BY 1, 2')
def timeline_density(spark, d):
    df, time, n = _events(spark, d)
    return fields.density(fields.binned_timeline(df, F.col("us"), F.col("lane"), time, n, TW, TH))


@query(_EV + " SELECT 'time' AS axis, bx AS bin, count(*) n FROM b GROUP BY bx UNION ALL SELECT 'lane', lane, count(*) FROM b GROUP BY lane")
def timeline_marginals(spark, d):
    df, time, n = _events(spark, d)
    b = fields.binned_timeline(df, F.col("us"), F.col("lane"), time, n, TW, n)
    return fields.marginals(fields.density(b)).select(F.when(F.col("axis") == "x", "time").otherwise("lane").alias("axis"), "bin", "n")


@query(_EV + " SELECT bx AS bin, count(*) n, 0.25::DOUBLE AS window_start, 0.75::DOUBLE AS window_end FROM b GROUP BY bx")
def timeline_overview(spark, d):
    df, (t0, t1), _ = _events(spark, d)
    quarter = (t1 - t0) / 4
    out = fields.time_overview(df, F.col("us"), (t0, t1), (t0 + quarter, t1 - quarter), TW)
    return out.select("bin", "n", F.round("window_start", 6).alias("window_start"), F.round("window_end", 6).alias("window_end"))


@query(f"WITH e AS (SELECT min({_US})::DOUBLE x0, max({_US})::DOUBLE x1, min(value) y0, max(value) y1 FROM events), b AS (SELECT least(CAST(floor(({_US}::DOUBLE - x0) / (x1 - x0) * 40) AS INT), 39) bx, least(CAST(floor((value - y0) / (y1 - y0) * 30) AS INT), 29) \"by\" FROM events, e) SELECT bx, \"by\", count(*) n FROM b GROUP BY 1, 2")
def time_value_density(spark, d):
    return VisualQuery(projection.Mapping("ts", "value", "time"), width=40, height=30).over(_t(spark, d, "events")).grid()


@query(f"WITH x AS (SELECT min({_US}) t0, max({_US}) t1 FROM events) SELECT event_id, round(({_US} - t0) / (t1 - t0)::DOUBLE, 9) AS fraction FROM events, x")
def time_fractions(spark, d):
    df = _t(spark, d, "events").withColumn("us", binning.micros(F.col("ts")))
    t0, t1 = df.agg(F.min("us"), F.max("us")).first()
    return df.select("event_id", F.round(binning.time_fraction(F.col("us"), t0, t1), 9).alias("fraction"))


# -- projections, cells and filters ----------------------------------------------------


@query("SELECT o_orderkey, CAST((o_totalprice + o_custkey) / 2 AS FLOAT) AS mean, CAST(o_totalprice - o_custkey AS FLOAT) AS difference FROM orders")
def mean_difference_projection(spark, d):
    return projection.mean_difference(_t(spark, d, "orders"), "o_totalprice", "o_custkey").select("o_orderkey", "mean", "difference")


#: Orders as text with induced gaps: every 7th price is blank and every 11th malformed, every 5th status blank.
_ROUGH = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END price, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' ' || o_orderstatus || ' ' END status FROM orders), p AS (SELECT *, trim(price) = '' pm, TRY_CAST(trim(price) AS DOUBLE) v, trim(status) = '' sm, trim(status) st FROM o)"


def _rough(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, " ").when(key % 11 == 0, "bad").otherwise(F.col("o_custkey").cast("string"))
    status = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    return _t(spark, d, "orders").select("o_orderkey", price.alias("price"), status.alias("status"))


@query(f"WITH {_ROUGH} SELECT o_orderkey, coalesce(v BETWEEN 100 AND 800, false) AS excluding, coalesce(v BETWEEN 100 AND 800, true) AS including FROM p")
def filter_numeric(spark, d):
    df = _rough(spark, d)
    one, two = (NumericRange("price", 100, 800, m).condition(df.schema["price"].dataType) for m in (False, True))
    return df.select("o_orderkey", one.alias("excluding"), two.alias("including"))


@query(f"WITH {_ROUGH} SELECT o_orderkey, CASE WHEN sm THEN false ELSE st IN ('F', 'P') END AS excluding, CASE WHEN sm THEN true ELSE st IN ('F', 'P') END AS including, sm AS only_missing FROM p")
def filter_category(spark, d):
    df = _rough(spark, d)
    kind = df.schema["status"].dataType
    f = lambda v, m: CategorySet("status", v, m).condition(kind)
    return df.select("o_orderkey", f(("F", "P"), False).alias("excluding"), f(("P", "F", "F"), True).alias("including"), f((), True).alias("only_missing"))


_ROUGH_SET = FilterSet().put(NumericRange("price", 100, 800)).put(CategorySet("status", ("F", "O")))
_ROUGH_IN = "(coalesce(v BETWEEN 100 AND 800, false) AND (NOT sm AND st IN ('F', 'O')))"


@query(f"WITH {_ROUGH} SELECT o_orderkey, {_ROUGH_IN} AS included FROM p")
def filter_and(spark, d):
    return Cohort(_ROUGH_SET).apply(_rough(spark, d)).select("o_orderkey", "included")


@query(f"WITH {_ROUGH}, i AS (SELECT *, {_ROUGH_IN} inc FROM p) SELECT count(*) total_rows, count(*) FILTER (inc) included_rows, count(*) FILTER (NOT inc AND (pm OR sm)) excluded_missing, count(*) FILTER (NOT inc AND NOT pm AND v IS NULL) excluded_invalid FROM i")
def cohort_stats(spark, d):
    return Cohort(_ROUGH_SET).stats(_rough(spark, d))


@query(f"WITH {_ROUGH} SELECT 'price' AS \"column\", min(o_orderkey) AS row_id FROM p WHERE NOT pm AND v IS NULL")
def cohort_reject_probe(spark, d):
    return first_invalid(_rough(spark, d), _ROUGH_SET, "o_orderkey")


@query(f"WITH {_ROUGH} SELECT o_orderkey, price AS raw, CASE WHEN pm THEN NULL ELSE v END AS value, CASE WHEN pm THEN 'missing' WHEN v IS NULL THEN 'invalid' ELSE 'value' END AS state FROM p")
def typed_cells(spark, d):
    return inference.decode(_rough(spark, d), {"price": "double"}).select("o_orderkey", "price.*")


@query(f"WITH {_ROUGH}, r AS (SELECT max(CASE WHEN pm THEN 0 WHEN regexp_full_match(trim(price), '[+-]?[0-9]+') THEN 1 WHEN v IS NOT NULL THEN 2 ELSE 3 END) a, 3 b, 1 k FROM p) SELECT unnest(['o_orderkey', 'price', 'status']) AS \"column\", unnest([(['Empty', 'Integer', 'Float', 'String'])[k + 1], (['Empty', 'Integer', 'Float', 'String'])[a + 1], (['Empty', 'Integer', 'Float', 'String'])[b + 1]]) AS kind FROM r")
def type_inference(spark, d):
    return inference.infer_frame(_rough(spark, d))


@query("WITH k AS (SELECT CAST(l_orderkey AS VARCHAR) k, count(*) n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, 0::BIGINT AS blank_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows, CAST(sum(length(k) + 32) AS BIGINT) AS index_bytes FROM k")
def key_validation(spark, d):
    return keys.key_report(_t(spark, d, "lineitem"), "l_orderkey")


@query("WITH k AS (SELECT event_type AS key, event_id r, row_number() OVER (PARTITION BY event_type ORDER BY event_id) i FROM events) SELECT key, max(r) FILTER (i = 1) AS first_row, max(r) FILTER (i = 2) AS second_row FROM k GROUP BY key HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return keys.duplicate_keys(_t(spark, d, "events"), "event_type", "event_id")


# -- categories ------------------------------------------------------------------------


@query("WITH c AS (SELECT o_orderpriority AS value, count(*) n FROM orders GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS value_id, value, n, false AS truncated FROM c")
def category_index(spark, d):
    return category.category_index(_t(spark, d, "orders"), "o_orderpriority", 256)


@query("WITH c AS (SELECT p_brand AS value, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 6) SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS value_id, value, n, true AS truncated FROM c")
def category_index_truncated(spark, d):
    return category.category_index(_t(spark, d, "part"), "p_brand", 6)


_PART_DOMAIN = (0.0, 50.0, 800.0, 2_200.0)
_CW, _CH = 10, 8
_RANKED = "k AS (SELECT p_brand, count(*) n, row_number() OVER (ORDER BY count(*) DESC, p_brand) r FROM part GROUP BY 1)"
_COMP = f"WITH {_RANKED}, b AS (SELECT least(CAST(floor(p_size / 50.0 * {_CW}) AS INT), {_CW - 1}) bx, least(CAST(floor((p_retailprice - 800.0) / 1400.0 * {_CH}) AS INT), {_CH - 1}) \"by\", CAST(CASE WHEN r <= 7 THEN r - 1 ELSE 7 END AS INT) layer FROM part JOIN k USING (p_brand) WHERE p_size BETWEEN 0 AND 50 AND p_retailprice BETWEEN 800 AND 2200), g AS (SELECT bx, \"by\", layer, count(*) n FROM b GROUP BY 1, 2, 3)"


def _composition(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, category.LayerPlan]:
    q = VisualQuery(projection.Mapping("p_size", "p_retailprice", category="p_brand"), "composition", width=_CW, height=_CH, domain=_PART_DOMAIN)
    bound = q.over(_t(spark, d, "part"))
    return bound.field(), bound.grid(), bound.layer_plan()


@query(f"WITH {_RANKED} SELECT CAST(r - 1 AS INT) AS layer, p_brand AS label, 'value' AS kind, n FROM k WHERE r <= 7 UNION ALL SELECT 7, 'Other', 'other', CAST(sum(n) AS BIGINT) FROM k WHERE r > 7 HAVING sum(n) > 0")
def category_layers(spark, d):
    plan = category.plan_layers(_t(spark, d, "part"), "p_brand")
    rows = [(x.layer, x.label, x.kind, x.n) for x in plan.layers]
    return spark.createDataFrame(rows, "layer int, label string, kind string, n long")


@query(_COMP + ' SELECT bx, "by", layer, n FROM g')
def composition_grid(spark, d):
    return _composition(spark, d)[0]


@query(_COMP + ', t AS (SELECT bx, "by", sum(n) total, max(n) m FROM g GROUP BY 1, 2), x AS (SELECT t.bx, t."by", total, min(layer) FILTER (n = m) dl, m, -sum(n / total * ln(n / total)) / ln(8) h FROM t JOIN g USING (bx, "by") GROUP BY t.bx, t."by", total, m) SELECT bx, "by", CAST(total AS BIGINT) AS total, dl AS dominant_layer, round(m / total, 9) AS dominant_share, round(abs(h), 7) AS entropy, round(1 - abs(h), 7) AS purity FROM x')
def composition_cells(spark, d):
    grid, _, plan = _composition(spark, d)
    out = category.composition_cells(grid, len(plan.layers))
    return out.select("bx", "by", "total", "dominant_layer", F.round("dominant_share", 9).alias("dominant_share"), F.abs(F.round("entropy", 7)).alias("entropy"), F.round("purity", 7).alias("purity"))


@query('SELECT 0::INT AS bx, 0::INT AS "by", 0::BIGINT AS layers_n, 0::BIGINT AS n WHERE false')
def composition_invariant(spark, d):
    grid, whole, _ = _composition(spark, d)
    return category.composition_mismatch(grid, whole)


# -- catalogs, profiles, missingness, diff -----------------------------------------------


@query("SELECT unnest(['c_custkey', 'c_acctbal', 'c_nationkey']) AS \"column\", unnest([min(c_custkey)::DOUBLE, min(c_acctbal), min(c_nationkey)::DOUBLE]) AS min, unnest([max(c_custkey)::DOUBLE, max(c_acctbal), max(c_nationkey)::DOUBLE]) AS max, unnest([count(c_custkey), count(c_acctbal), count(c_nationkey)]) AS valid, unnest([0, 0, 0])::BIGINT AS missing, unnest([0, 0, 0])::BIGINT AS invalid FROM customer")
def field_catalog_numeric(spark, d):
    return catalog.numeric_catalog(_t(spark, d, "customer"), ["c_custkey", "c_acctbal", "c_nationkey"])


@query("WITH v AS (SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM v) SELECT \"column\", CAST(rank AS INT) AS rank, value, n FROM r WHERE rank <= 4")
def field_catalog_categorical(spark, d):
    return catalog.top_values(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 4)


@query("SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS \"distinct\", count(p_brand) AS valid, 0::BIGINT AS missing, count(DISTINCT p_brand) > 20 AS truncated FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name), count(p_name), 0, count(DISTINCT p_name) > 20 FROM part")
def categorical_summary(spark, d):
    return catalog.categorical_catalog(_t(spark, d, "part"), ["p_brand", "p_name"], 20)


@query("WITH c AS (SELECT p_brand v, count(*) n, min(p_partkey) f FROM part GROUP BY 1), k AS (SELECT * FROM c ORDER BY f LIMIT 10), l AS (SELECT * FROM k ORDER BY n DESC, v LIMIT 3) SELECT (SELECT count(*) FROM part) AS valid, 0::BIGINT AS missing, 0::BIGINT AS invalid, CASE WHEN (SELECT count(*) FROM c) > 10 THEN 11 ELSE (SELECT count(*) FROM c) END AS \"distinct\", CASE WHEN (SELECT count(*) FROM c) > 10 THEN 'at_least' ELSE 'exact' END AS accuracy, (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM l) AS leaders")
def column_profile(spark, d):
    return catalog.column_profile(_t(spark, d, "part"), "p_brand", "p_partkey", 10, 3)


_LABELLED = "j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    return docs.join(_t(spark, d, "labels"), "doc_id", "left")


@query(f"WITH {_LABELLED}, i AS (SELECT * FROM j WHERE lang IN ('en', 'de')) SELECT unnest(['lang', 'quality', 'toxic']) AS \"column\", unnest([count(*) - count(lang), count(*) - count(quality), count(*) - count(toxic)]) AS missing, unnest([0, 0, 0])::BIGINT AS invalid, unnest([count(*), count(*), count(*)]) AS included FROM i")
def cohort_missingness(spark, d):
    marked = Cohort(FilterSet().put(CategorySet("lang", ("en", "de")))).apply(_labelled(spark, d))
    return catalog.cohort_missingness(marked, ["lang", "quality", "toxic"])


@query(f"WITH {_LABELLED}, n AS (SELECT count(*) n FROM documents), b AS (SELECT CAST(((doc_id + 1) * 16 - 1) // n AS INT) bucket, quality, toxic FROM j, n) SELECT bucket, 'quality' AS \"column\", count(*) - count(quality) AS missing, count(*) AS total FROM b GROUP BY 1 UNION ALL SELECT bucket, 'toxic', count(*) - count(toxic), count(*) FROM b GROUP BY 1")
def missingness_grid(spark, d):
    return missingness.missingness_grid(_labelled(spark, d), "doc_id", ["quality", "toxic"], 16)


@query(f"WITH {_LABELLED}, n AS (SELECT count(*) n FROM documents), b AS (SELECT doc_id, ((doc_id + 1) * 16 - 1) // n bucket, quality IS NULL q, toxic IS NULL t FROM j, n), s AS (SELECT * FROM b WHERE bucket BETWEEN 2 AND 4), i AS (SELECT doc_id FROM s WHERE q OR t ORDER BY doc_id LIMIT 50) SELECT CAST(sum(q::INT + t::INT) AS BIGINT) AS missing, count(*) * 2 AS total, count(*) FILTER (q OR t) AS rows_with_missing, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM i) AS row_ids, 'quality,toxic' AS columns FROM s")
def missingness_selection(spark, d):
    out = missingness.missingness_selection(_labelled(spark, d), "doc_id", ["quality", "toxic"], 16, (2, 5), (0, 2), 50)
    return out.withColumn("row_ids", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ","))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("c_name"), "c_nationkey", "c_acctbal")
    gap = F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_name"))
    after = _t(spark, d, "customer").where("c_custkey % 10 != 0").select("c_custkey", gap.alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    return before, after


@query("SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS \"column\", unnest(['Float', 'Integer', NULL, 'String', 'Integer']) AS before_kind, unnest([NULL, 'Integer', 'String', 'String', 'String']) AS after_kind, unnest(['removed', 'unchanged', 'added', 'unchanged', 'type_changed']) AS status")
def dataset_diff_columns(spark, d):
    return diff.diff_columns(*_versions(spark, d))


@query("WITH b AS (SELECT count(*) n, count(*) FILTER (c_custkey % 7 = 0) m FROM customer), a AS (SELECT count(*) n, count(*) FILTER (c_custkey % 3 = 0) m FROM customer WHERE c_custkey % 10 != 0) SELECT unnest(['c_custkey', 'c_name', 'c_nationkey']) AS \"column\", unnest([0, b.m, 0])::BIGINT AS before_missing, unnest([0, a.m, 0])::BIGINT AS after_missing, unnest([0, a.m - b.m, 0])::BIGINT AS missing_delta, unnest([0.0, round((a.m / a.n::DOUBLE - b.m / b.n::DOUBLE) * 100, 9), 0.0])::DOUBLE AS ratio_delta_pp, unnest([a.n - b.n, a.n - b.n, a.n - b.n])::BIGINT AS row_delta FROM a, b")
def dataset_diff_missingness(spark, d):
    return diff.diff_missingness(*_versions(spark, d)).withColumn("ratio_delta_pp", F.round("ratio_delta_pp", 9))


# -- selections --------------------------------------------------------------------------

_BOX = (100.0, 700.0, 50_000.0, 200_000.0)
_SEL = "(o_custkey BETWEEN 100 AND 700 AND o_totalprice BETWEEN 50000 AND 200000)"


def _selected() -> F.Column:
    return in_box(F.col("o_custkey").cast("double"), F.col("o_totalprice"), _BOX)


@query(f"WITH s AS (SELECT *, {_SEL} sel FROM orders), k AS (SELECT o_orderstatus, count(*) n FROM s WHERE sel GROUP BY 1) SELECT count(*) AS total_rows, count(*) FILTER (sel) AS selected_rows, min(o_custkey) FILTER (sel) AS x_min, max(o_custkey) FILTER (sel) AS x_max, min(o_totalprice) FILTER (sel) AS y_min, max(o_totalprice) FILTER (sel) AS y_max, round((count(*) FILTER (sel)) / count(*) * 100.0::DOUBLE, 3) AS selected_percentage, (SELECT o_orderstatus FROM k ORDER BY n DESC, o_orderstatus DESC LIMIT 1) AS top_kind FROM s")
def selection_summary(spark, d):
    out = selection.scatter_summary(_t(spark, d, "orders"), _selected(), "o_custkey", "o_totalprice", "o_orderstatus")
    return out.withColumn("selected_percentage", F.round(F.col("selected_percentage").cast("double"), 3))


@query(f"WITH g AS (SELECT o_orderpriority AS \"group\", count(*) FILTER ({_SEL}) selected, count(*) baseline FROM orders GROUP BY 1), t AS (SELECT sum(selected) s, sum(baseline) b FROM g) SELECT \"group\", selected, baseline, round(selected / s * 100, 6) AS selected_pct, round(baseline / b * 100, 6) AS baseline_pct, round(selected / s * 100 - baseline / b * 100, 6) AS delta_pp FROM g, t")
def selection_comparison(spark, d):
    out = selection.group_comparison(_t(spark, d, "orders"), _selected(), "o_orderpriority")
    return out.select("group", "selected", "baseline", *[F.round(c, 6).alias(c) for c in ("selected_pct", "baseline_pct", "delta_pp")])


@query(f"WITH s AS (SELECT * FROM orders WHERE {_SEL}), n AS (SELECT count(*) n FROM s) SELECT o_orderkey, o_custkey, o_totalprice, n AS selected_rows, least(n, 25) AS displayed_rows, n > 25 AS sampled FROM s, n ORDER BY o_orderkey LIMIT 25")
def drilldown_rows(spark, d):
    return selection.drilldown(_t(spark, d, "orders"), _selected(), "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"], 25)


@query(f"WITH s AS (SELECT o_orderkey FROM orders WHERE {_SEL}) SELECT o.o_orderkey, o.o_orderpriority FROM orders o WHERE o.o_orderkey IN (SELECT o_orderkey FROM s)")
def snapshot_membership(spark, d):
    df = _t(spark, d, "orders")
    snap = selection.snapshot_of(df, _selected(), "o_orderkey")
    return selection.snapshot_rows(df, snap, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderkey FROM orders WHERE {_SEL} AND o_orderkey % 9 = 0")
def unavailable_rows(spark, d):
    df = _t(spark, d, "orders")
    snap = selection.snapshot_of(df, _selected(), "o_orderkey")
    return selection.unavailable(snap, df.where("o_orderkey % 9 != 0"), "o_orderkey")


@query(f"SELECT DISTINCT CAST((31 - least(CAST(floor((o_totalprice - 50000.0) / 150000.0 * 32) AS INT), 31)) * 32 + least(CAST(floor((o_custkey - 100.0) / 600.0 * 32) AS INT), 31) AS INT) AS bin FROM orders WHERE {_SEL}")
def selection_bins(spark, d):
    return selection.selection_bins(_t(spark, d, "orders"), _selected(), F.col("o_custkey").cast("double"), F.col("o_totalprice"), _BOX, 32, 32)


_TSEL = "(us BETWEEN t0 + (t1 - t0) // 4 AND t0 + (t1 - t0) // 2 AND lane >= 1 AND lane < 4)"


def _brushed(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    df, (t0, t1), _ = _events(spark, d)
    return df, in_time_brush(F.col("us"), F.col("lane"), (t0 + (t1 - t0) // 4, t0 + (t1 - t0) // 2), (1, 4))


@query(_EV + f", s AS (SELECT *, {_TSEL} sel FROM v) SELECT count(*) AS total_events, count(*) FILTER (sel) AS selected_events, min(us) FILTER (sel) AS time_min, max(us) FILTER (sel) AS time_max, min(value) FILTER (sel) AS value_min, max(value) FILTER (sel) AS value_max, round((count(*) FILTER (sel)) / count(*) * 100.0::DOUBLE, 6) AS selected_percentage, (SELECT lane FROM s WHERE sel GROUP BY lane ORDER BY count(*) DESC, lane DESC LIMIT 1) AS top_lane, (SELECT event_type FROM s WHERE sel GROUP BY event_type ORDER BY count(*) DESC, event_type DESC LIMIT 1) AS top_kind FROM s")
def timeline_selection(spark, d):
    df, sel = _brushed(spark, d)
    return selection.timeline_summary(df, sel, "us", "lane", "value", "event_type").withColumn("selected_percentage", F.round("selected_percentage", 6))


@query(_EV + f", s AS (SELECT lane, count(*) FILTER ({_TSEL}) selected, count(*) baseline FROM v GROUP BY lane), t AS (SELECT sum(selected) s, sum(baseline) b FROM s) SELECT lane AS \"group\", selected, baseline, round(selected / t.s * 100, 6) AS selected_pct, round(baseline / b * 100, 6) AS baseline_pct, round(selected / t.s * 100 - baseline / b * 100, 6) AS delta_pp FROM s, t")
def timeline_comparison(spark, d):
    df, sel = _brushed(spark, d)
    out = selection.group_comparison(df, sel, "lane")
    return out.select("group", "selected", "baseline", *[F.round(c, 6).alias(c) for c in ("selected_pct", "baseline_pct", "delta_pp")])


_OB = "b AS (SELECT o_orderkey, least(CAST(floor((o_custkey - 0.0) / 2000.0 * 12) AS INT), 11) bx, least(CAST(floor(o_totalprice / 600000.0 * 10) AS INT), 9) \"by\" FROM orders WHERE o_custkey BETWEEN 0 AND 2000 AND o_totalprice BETWEEN 0 AND 600000)"


def _order_bins(spark: SparkSession, d: str) -> DataFrame:
    return fields.binned(_t(spark, d, "orders"), F.col("o_custkey").cast("double"), F.col("o_totalprice"), (0.0, 2_000.0, 0.0, 600_000.0), 12, 10)


@query(f"WITH {_OB}, r AS (SELECT *, row_number() OVER (PARTITION BY bx, \"by\" ORDER BY o_orderkey) i FROM b) SELECT bx, \"by\", count(*) n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (i <= 8) AS row_ids FROM r GROUP BY 1, 2")
def aggregate_overview(spark, d):
    out = fields.overview(_order_bins(spark, d), "o_orderkey", 8)
    return out.withColumn("row_ids", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ","))


@query(f"WITH {_OB}, g AS (SELECT bx, \"by\", count(*) n FROM b GROUP BY 1, 2), m AS (SELECT bx, \"by\" FROM g ORDER BY n DESC, bx, \"by\" LIMIT 1), r AS (SELECT o_orderkey FROM b JOIN m USING (bx, \"by\") ORDER BY o_orderkey LIMIT 16) SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) n, (SELECT max(n) FROM g) > 16 AS sampled FROM orders JOIN r USING (o_orderkey) GROUP BY 2")
def pinned_categories(spark, d):
    b = _order_bins(spark, d)
    top = fields.density(b).orderBy(F.desc("n"), "bx", "by").first()
    rows = selection.lowest_rows(b.where((F.col("bx") == top.bx) & (F.col("by") == top["by"])), "o_orderkey", 16)
    return selection.category_of_rows(rows, ["o_orderpriority"], top.n)


@query(f"WITH i AS (SELECT o_orderkey FROM orders WHERE {_SEL} ORDER BY 1 LIMIT 20) SELECT (SELECT count(*) FROM orders WHERE {_SEL}) AS selected_rows, (SELECT count(*) FROM orders) AS total_rows, '{{\"selected_rows\":' || (SELECT count(*) FROM orders WHERE {_SEL}) || ',\"total_rows\":' || (SELECT count(*) FROM orders) || ',\"row_ids\":[' || (SELECT string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM i) || ']}}' AS document")
def evidence_document(spark, d):
    return evidence.evidence_rows(_t(spark, d, "orders"), _selected(), "o_orderkey", 20)


# -- reveal --------------------------------------------------------------------------------

_MOD = "18446744073709551616::UHUGEINT"
_MIXED = f"h0 AS (SELECT event_id, user_id, value, (event_id::UHUGEINT + 11400714819323198485::UHUGEINT) % {_MOD} z FROM events WHERE user_id BETWEEN 10 AND 400 AND value BETWEEN 5 AND 200), h1 AS (SELECT * REPLACE (((xor(z, z // 1073741824)) * 13787848793156543929::UHUGEINT) % {_MOD} AS z) FROM h0), h2 AS (SELECT * REPLACE (((xor(z, z // 134217728)) * 10723151780598845931::UHUGEINT) % {_MOD} AS z) FROM h1), h3 AS (SELECT * REPLACE (xor(z, z // 2147483648) AS z) FROM h2)"


@query(f"WITH {_MIXED} SELECT event_id AS row_id, user_id::DOUBLE AS px, value AS py FROM h3 ORDER BY z, event_id LIMIT 200")
def point_reveal_sample(spark, d):
    df = _t(spark, d, "events")
    return reveal.reveal_plan(df, F.col("user_id").cast("double"), F.col("value"), (10.0, 400.0, 5.0, 200.0), "event_id", most=200)


@query("WITH d AS (SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.07, 0.12, 3.0])::DOUBLE r), a AS (SELECT r, greatest(0, least(1, (0.12::DOUBLE - r) / (0.12::DOUBLE - 0.02::DOUBLE))) a FROM d) SELECT r AS rows_per_pixel, round(greatest(0.12, least(1, 1 - a * 0.88)), 9) AS density_alpha, round(a, 9) AS point_alpha FROM a")
def semantic_zoom(spark, d):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.01, 0.02, 0.05, 0.07, 0.12, 3.0)], "r double")
    z = df.select("r", encodings.semantic_zoom(F.col("r")).alias("z"))
    return z.select(F.col("r").alias("rows_per_pixel"), F.round("z.density_alpha", 9).alias("density_alpha"), F.round("z.point_alpha", 9).alias("point_alpha"))


@query("WITH RECURSIVE k AS (SELECT range::UHUGEINT i FROM range(500)), h0 AS (SELECT i, (i + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT z FROM k), h1 AS (SELECT i, (xor(z, z // 1073741824) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT z FROM h0), h2 AS (SELECT i, (xor(z, z // 134217728) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT z FROM h1) SELECT i::BIGINT AS row_id, CAST(xor(z, z // 2147483648) AS VARCHAR) AS priority FROM h2")
def stable_priorities(spark, d):
    p = hashing.stable_priority(F.col("id"))
    text = F.when(p >= 0, p.cast("decimal(20,0)")).otherwise(p.cast("decimal(20,0)") + F.expr("18446744073709551616BD")).cast("decimal(20,0)").cast("string")
    return spark.range(500).select(F.col("id").alias("row_id"), text.alias("priority"))


# -- intervals -----------------------------------------------------------------------------

# samples: minutes of the first days, active where a user's events (target) or errors (against) occur
_SAMPLES = "s AS (SELECT user_id % 5 AS k, (epoch_us(ts) // 1800000000) AS p, event_type FROM events), p0 AS (SELECT min(p) m FROM s), q AS (SELECT k, p - m AS p, event_type FROM s, p0)"
_ISLAND = "SELECT k, min(p) AS \"start\", max(p) + 1 AS \"end\" FROM (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) i FROM (SELECT DISTINCT k, p FROM q WHERE event_type = '{}')) GROUP BY k, i"
_WINDOWS = f"{_SAMPLES}, t AS ({_ISLAND.format('click')}), a AS ({_ISLAND.format('view')})"
_SEGMENTS = f"WITH {_WINDOWS}, e AS (SELECT DISTINCT k, p FROM (SELECT k, \"start\" p FROM t UNION ALL SELECT k, \"end\" FROM t UNION ALL SELECT k, \"start\" FROM a UNION ALL SELECT k, \"end\" FROM a)), g AS (SELECT k, p AS s, lead(p) OVER (PARTITION BY k ORDER BY p) AS e FROM e), c AS (SELECT k, s, e, EXISTS (SELECT 1 FROM t WHERE t.k = g.k AND t.\"start\" <= g.s AND g.s < t.\"end\") AS tt, EXISTS (SELECT 1 FROM a WHERE a.k = g.k AND a.\"start\" <= g.s AND g.s < a.\"end\") AS aa FROM g WHERE e IS NOT NULL)"
_MERGE = ", w AS (SELECT *, sum(o) OVER (PARTITION BY k, cls ORDER BY s) r FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY k, cls ORDER BY s) = s THEN 0 ELSE 1 END o FROM f)) SELECT k, min(s) AS \"start\", max(e) AS \"end\" FROM w GROUP BY k, cls, r"


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _t(spark, d, "events")
    p = F.call_function("div", binning.micros(F.col("ts")), F.lit(1_800_000_000).cast("long"))
    first = e.agg(F.min(p)).first()[0]
    q = e.select((F.col("user_id") % 5).alias("k"), (p - first).alias("p"), "event_type")
    target = intervals.contiguous_ranges(q, "p", F.col("event_type") == "click", ["k"])
    against = intervals.contiguous_ranges(q, "p", F.col("event_type") == "view", ["k"])
    return q, target, against


@query(f"WITH {_WINDOWS} SELECT k, \"start\", \"end\" FROM t")
def contiguous_ranges(spark, d):
    return _windows(spark, d)[1]


@query(f"WITH {_WINDOWS} SELECT k, \"start\" AS position, 1::INT AS active, 'target' AS source FROM t UNION ALL SELECT k, \"end\", 0, 'target' FROM t")
def boundary_events(spark, d):
    return intervals.boundary_events(_windows(spark, d)[1], "target", ["k"])


def _family(spark: SparkSession, d: str, family: str) -> DataFrame:
    _, t, a = _windows(spark, d)
    return intervals.compare_intervals(t, a, ["k"], [family]).select("k", "start", "end")


@query(_SEGMENTS + ", f AS (SELECT k, s, e, 1 AS cls FROM c WHERE tt AND aa)" + _MERGE)
def interval_overlap(spark, d):
    return _family(spark, d, "overlap")


@query(_SEGMENTS + ", f AS (SELECT k, s, e, 1 AS cls FROM c WHERE tt AND NOT aa)" + _MERGE)
def interval_residual(spark, d):
    return _family(spark, d, "residual")


@query(_SEGMENTS + ", f AS (SELECT k, s, e, 1 AS cls FROM c WHERE aa AND NOT tt)" + _MERGE)
def interval_missing(spark, d):
    return _family(spark, d, "missing")


@query(_SEGMENTS + ", f AS (SELECT k, s, e, 1 AS cls FROM c WHERE NOT aa AND NOT tt)" + _MERGE)
def interval_gap(spark, d):
    return _family(spark, d, "gap")


@query(_SEGMENTS + ", f AS (SELECT k, s, e, tt AS cls FROM c WHERE aa <> tt)" + _MERGE)
def interval_symmetric_difference(spark, d):
    return _family(spark, d, "symmetric_difference")


_COVER = _SEGMENTS + ", f AS (SELECT k, s, e, aa AS cls FROM c WHERE tt), w AS (SELECT *, sum(o) OVER (PARTITION BY k, cls ORDER BY s) r FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY k, cls ORDER BY s) = s THEN 0 ELSE 1 END o FROM f)), v AS (SELECT k, min(s) s, max(e) e, cls FROM w GROUP BY k, cls, r)"


@query(_COVER + ' SELECT k, s AS "start", e AS "end", e - s AS target_magnitude, CASE WHEN cls THEN e - s ELSE 0 END AS covered_magnitude, CASE WHEN cls THEN 1.0 ELSE 0.0 END::DOUBLE AS ratio FROM v')
def interval_coverage(spark, d):
    _, t, a = _windows(spark, d)
    return intervals.coverage(t, a, ["k"])


@query(f"WITH {_WINDOWS}, n AS (SELECT t.k, t.\"start\" s, t.\"end\" e, (SELECT max(a.\"start\") FROM a WHERE a.k = t.k AND a.\"start\" < t.\"end\") z FROM t), m AS (SELECT n.*, a.\"start\" zs, a.\"end\" ze FROM n LEFT JOIN a ON a.k = n.k AND a.\"start\" = z) SELECT k, s AS \"start\", e AS \"end\", CASE WHEN zs IS NULL OR ze <= s OR (s < zs AND e > ze) THEN 'not_contained' WHEN s < zs THEN 'left_overhang' WHEN e > ze THEN 'right_overhang' ELSE 'contained' END AS status FROM m")
def interval_containment(spark, d):
    _, t, a = _windows(spark, d)
    return intervals.containment(t, a, ["k"])


@query(_COVER + ", o AS (SELECT k, s, e, CASE WHEN tt AND aa THEN 'overlap' WHEN tt THEN 'residual' ELSE 'missing' END AS cls FROM c WHERE tt OR aa), ow AS (SELECT *, sum(x) OVER (PARTITION BY k, cls ORDER BY s) r FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY k, cls ORDER BY s) = s THEN 0 ELSE 1 END x FROM o)), iv AS (SELECT cls, min(s) s, max(e) e FROM ow GROUP BY k, cls, r), z AS (SELECT sum(e - s) tt, sum(CASE WHEN cls THEN e - s ELSE 0 END) cc FROM v) SELECT cls AS family, count(*) AS interval_count, CAST(sum(e - s) AS BIGINT) AS total_duration, round(sum(e - s) / count(*), 9) AS mean_duration, CAST(max(z.tt) AS BIGINT) AS target_total, CAST(max(z.cc) AS BIGINT) AS covered_total, round(max(z.cc / z.tt), 9) AS coverage_ratio FROM iv, z GROUP BY cls")
def interval_rollup(spark, d):
    _, t, a = _windows(spark, d)
    rows = intervals.compare_intervals(t, a, ["k"], ["overlap", "residual", "missing"])
    out = intervals.interval_rollup(rows, intervals.coverage(t, a, ["k"]))
    return out.withColumns({"mean_duration": F.round("mean_duration", 9), "coverage_ratio": F.round("coverage_ratio", 9)})


@query(f"WITH {_WINDOWS}, d AS (SELECT DISTINCT k, p FROM q), x AS (SELECT k, p, EXISTS (SELECT 1 FROM t WHERE t.k = d.k AND \"start\" <= p AND p < \"end\") tt, EXISTS (SELECT 1 FROM a WHERE a.k = d.k AND \"start\" <= p AND p < \"end\") aa FROM d) SELECT k, p, CASE WHEN tt AND aa THEN 'detected_anomaly' WHEN tt THEN 'missed_anomaly' WHEN aa THEN 'false_positive' ELSE 'outside_anomaly' END AS comparison_state FROM x")
def state_timeline(spark, d):
    q, t, a = _windows(spark, d)
    rows = intervals.compare_intervals(t, a, ["k"], ["overlap", "residual", "missing"])
    return intervals.state_timeline(q.select("k", "p").distinct(), "p", rows, ["k"])


# -- sources ---------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, min(l_quantity) AS x_min, max(l_quantity) AS x_max, min(l_extendedprice) AS y_min, max(l_extendedprice) AS y_max, 0::BIGINT AS first_id, count(*) - 1 AS last_id, count(*) AS ids FROM lineitem")
def scatter_scan(spark, d):
    loaded = readers.bind_scatter(readers.read_table(spark, f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice")
    ends = {"x_min": (F.min("px"), F.min), "x_max": (F.max("px"), F.max), "y_min": (F.min("py"), F.min), "y_max": (F.max("py"), F.max), "first_id": (F.min("row_id"), F.min), "last_id": (F.max("row_id"), F.max)}
    return readers.aggregate_with_ids(loaded.rows, "row_id", rows=(F.count(F.lit(1)), F.sum), **ends)


@query(f"WITH {_LANES} SELECT lane, count(*) AS n, min(user_id) AS first_time, max(user_id) AS last_time FROM events JOIN l USING (event_type) GROUP BY lane")
def timeline_scan(spark, d):
    loaded = readers.bind_timeline(_t(spark, d, "events"), "user_id", "event_type", "event_id")
    return loaded.rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))


@query()
def synthetic_points(spark, d):
    return synthetic.synthetic_points(spark, 20_000)


@query()
def synthetic_events(spark, d):
    return synthetic.synthetic_events(spark, 20_000)


# -- the front door: kinds, row ids, limits, text files ------------------------------------------

#: Kind of a DuckDB column type, over DESCRIBE.
_KIND = "CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'Integer' WHEN column_type IN ('FLOAT', 'DOUBLE') THEN 'Float' WHEN column_type = 'VARCHAR' THEN 'String' WHEN column_type = 'TIMESTAMP' THEN 'Timestamp' ELSE 'Unsupported' END"


def _as_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    """The table as text files with a header in the shared folder; a local session may use its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fieldglass-csv-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}.csv"
    df.write.option("header", True).csv(path)
    return path


@query(f"SELECT column_name AS \"column\", {_KIND} AS kind FROM (DESCRIBE events) UNION ALL SELECT column_name, {_KIND} FROM (DESCRIBE lineitem)")
def parquet_schema(spark, d):
    rows = [x for t in ("events", "lineitem") for x in readers.table_schema(spark, f"{d}/{t}.parquet")]
    return spark.createDataFrame(rows, "column string, kind string")


@query(f"SELECT column_name AS \"column\", {_KIND} AS kind FROM (DESCRIBE customer)")
def csv_schema(spark, d):
    path = _as_csv(spark, _t(spark, d, "customer"), "customer")
    return spark.createDataFrame(readers.table_schema(spark, path), "column string, kind string")


@query("SELECT count(*) AS rows, min(p_partkey)::DOUBLE AS x_min, max(p_partkey)::DOUBLE AS x_max, min(p_retailprice) AS y_min, max(p_retailprice) AS y_max, count(*) AS ids, count(*) - 1 AS last_id, round(sum(p_retailprice), 4) AS y_sum FROM part")
def csv_scatter_binding(spark, d):
    loaded = readers.load_scatter(spark, _as_csv(spark, _t(spark, d, "part"), "part"), "p_partkey", "p_retailprice")
    found = readers.aggregate_with_ids(loaded.rows, "row_id", last_id=(F.max("row_id"), F.max), y_sum=(F.sum("py"), lambda c: F.round(F.sum(c), 4)))
    ends = [F.lit(float(v)).alias(n) for n, v in zip(("x_min", "x_max", "y_min", "y_max"), (*loaded.x_range, *loaded.y_range), strict=True)]
    return found.select(F.lit(loaded.count).cast("long").alias("rows"), *ends, "ids", "last_id", "y_sum")


@query("SELECT event_type, count(*) AS n, min(user_id) AS first_time, max(user_id) AS last_time, (SELECT count(DISTINCT event_type) FROM events) AS lanes, sum(count(*)) OVER ()::BIGINT AS events FROM events GROUP BY event_type")
def csv_timeline_binding(spark, d):
    loaded = readers.load_timeline(spark, _as_csv(spark, _t(spark, d, "events").select("user_id", "event_type"), "events"), "user_id", "event_type")
    label = F.element_at(F.array(*[F.lit(x) for x in loaded.labels]), F.col("lane") + 1)
    groups = loaded.rows.groupBy(label.alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("long").alias("first_time"), F.max("ts").cast("long").alias("last_time"))
    return groups.select("*", F.lit(len(loaded.labels)).cast("long").alias("lanes"), F.lit(loaded.count).cast("long").alias("events"))


@query("SELECT least(count(*), 700) AS rows, 0::BIGINT AS first_id, least(count(*), 700) - 1 AS last_id FROM customer")
def csv_row_limit(spark, d):
    rows = readers.read_table(spark, _as_csv(spark, _t(spark, d, "customer"), "customer"), 700)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query("SELECT o_orderkey AS row_id, o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000")
def parquet_row_limit(spark, d):
    return readers.read_table(spark, f"{d}/orders.parquet", 1_000).select("row_id", "o_orderkey", "o_totalprice")


@query("SELECT event_id AS row_id, event_id, event_type FROM events")
def row_identity(spark, d):
    return readers.number_parquet_rows(_t(spark, d, "events")).select("row_id", "event_id", "event_type")


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def source_row_text(spark, d):
    named = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name")
    return readers.source_text(_t(spark, d, "customer").select("c_custkey", named, "c_nationkey"))


@query("SELECT n_nationkey::BIGINT AS row_id, n_name AS value FROM nation WHERE n_nationkey IN (0, 7, 24)")
def cell_lookup(spark, d):
    nations = _t(spark, d, "nation").withColumn("row_id", F.col("n_nationkey").cast("long"))
    return spark.createDataFrame([(i, readers.cell_at(nations, i, "n_name")) for i in (0, 7, 24)], "row_id long, value string")


_WIDE = "18446744073709550000"


@query(f"SELECT unnest(['key', 'wide', 'balance', 'name', 'blank']) AS \"column\", unnest(['Integer', 'Integer', 'Float', 'String', 'Empty']) AS kind, unnest([CASE WHEN max(c_custkey)::HUGEINT > 9223372036854775807 THEN 'decimal(20,0)' ELSE 'bigint' END, CASE WHEN {_WIDE}::HUGEINT + max(c_custkey % 1000) > 9223372036854775807 THEN 'decimal(20,0)' ELSE 'bigint' END, 'double', 'string', 'string']) AS stored FROM customer")
def store_types(spark, d):
    wide = (F.expr(f"{_WIDE}BD") + F.col("c_custkey") % 1_000).cast("decimal(20,0)")
    text = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), wide.cast("string").alias("wide"), F.col("c_acctbal").cast("string").alias("balance"), F.col("c_name").alias("name"), F.lit(" ").alias("blank"))
    kinds = inference.infer_kinds(text)
    stored = inference.store_types(text, kinds)
    return spark.createDataFrame([(c, kinds[c], stored[c]) for c in text.columns], "column string, kind string, stored string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def frame_source(spark, d):
    nations = _t(spark, d, "nation").toPandas()  # 25 rows stand for a user's own frame
    return readers.from_frame(spark, nations, ("n_nationkey", "n_name")).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(f"SELECT o.o_orderkey, p.o_orderpriority, p.o_totalprice FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey AND p.o_orderkey % 9 <> 0 WHERE o.o_orderkey IN (SELECT o_orderkey FROM orders WHERE {_SEL})")
def source_row_lookup(spark, d):
    df = _t(spark, d, "orders")
    snap = selection.snapshot_of(df, _selected(), "o_orderkey")
    return selection.source_rows(snap, df.where("o_orderkey % 9 != 0").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")


@query("SELECT unnest([0, 1, 2, 3])::INT AS ordinal, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal']) AS before, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS after, unnest(['unchanged', 'unchanged', 'type_changed', 'renamed']) AS status")
def schema_by_ordinal(spark, d):
    before, after = _versions(spark, d)
    return spark.createDataFrame(diff.diff_by_ordinal(before.schema, after.schema), "ordinal int, before string, after string, status string")


# -- joins and shapes of intervals -----------------------------------------------------------------


@query("SELECT event_id AS \"start\", event_id + 21 AS \"end\" FROM events WHERE event_id % 50 = 0 AND event_id + 20 <= (SELECT max(event_id) FROM events)")
def label_windows(spark, d):
    """Windows named by the first and the last timestamp of 21 samples, found again by an equi-join."""
    at = lambda p: p * 60 + 7
    samples = _t(spark, d, "events").select("event_id", at(F.col("event_id")).alias("t"))
    last = samples.agg(F.max("event_id")).first()[0]
    labels = samples.where((F.col("event_id") % 50 == 0) & (F.col("event_id") + 20 <= last)).select(F.col("t").alias("start_ts"), at(F.col("event_id") + 20).alias("end_ts"))
    return intervals.label_ranges(labels, samples, "t", "event_id")


@query("SELECT event_id, ts, value, value * 2 AS score FROM events")
def aligned_samples(spark, d):
    events = _t(spark, d, "events")
    return intervals.aligned(events.select("event_id", "ts", "value"), events.select("event_id", "ts", (F.col("value") * 2).alias("score")), "event_id", "ts")


@query(f"WITH {_WINDOWS} SELECT k, \"start\", \"end\", min(\"start\") OVER () AS origin, (\"start\" - min(\"start\") OVER ())::DOUBLE AS start_offset, \"end\" - \"start\" AS duration FROM t")
def interval_shapes(spark, d):
    return intervals.shape_rows(_windows(spark, d)[1])


@query(_COMP + f', r AS (SELECT layer, label FROM (SELECT CAST(r - 1 AS INT) layer, p_brand label FROM k WHERE r <= 7 UNION ALL SELECT 7, \'Other\')) SELECT bx, "by", CAST(sum(n) OVER (PARTITION BY bx, "by") AS BIGINT) AS total, layer, label, n, round(n / sum(n) OVER (PARTITION BY bx, "by"), 9) AS share FROM g JOIN r USING (layer)')
def composition_inspection(spark, d):
    grid, _, plan = _composition(spark, d)
    cells = category.inspect_cells(grid, plan).select("bx", "by", "total", F.explode("layers").alias("x"))
    return cells.select("bx", "by", "total", "x.layer", "x.label", "x.n", F.round("x.share", 9).alias("share"))


@query(f"WITH {_MIXED}, c AS (SELECT count(*) n FROM h3) SELECT event_id AS row_id, value AS py, n AS eligible, round(greatest(0, least(1, (0.12::DOUBLE - n / 250000.0::DOUBLE) / (0.12::DOUBLE - 0.02::DOUBLE))), 9) AS blend, n > 200 AS sampled FROM h3, c WHERE n / 250000.0::DOUBLE < 0.12 ORDER BY z, event_id LIMIT 200")
def reveal_decision(spark, d):
    df = _t(spark, d, "events")
    points, made = reveal.reveal_selection(df, F.col("user_id").cast("double"), F.col("value"), (10.0, 400.0, 5.0, 200.0), "event_id", (500, 500), most=200)
    return points.select("row_id", "py", F.lit(made["eligible"]).cast("long").alias("eligible"), F.lit(round(made["blend"], 9)).alias("blend"), F.lit(made["sampled"]).alias("sampled"))


# -- arithmetic of axes and views, on the extents of tables ----------------------------------------

_TICKS = "SELECT '{c}' AS axis, min({c})::DOUBLE lo, max({c})::DOUBLE hi FROM lineitem"


@query("WITH e AS (" + " UNION ALL ".join(_TICKS.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")) + "), s AS (SELECT *, (hi - lo) / 4 AS least, pow(10, floor(log10((hi - lo) / 4))) AS d FROM e), t AS (SELECT *, d * CASE WHEN least <= d THEN 1 WHEN least <= 2 * d THEN 2 WHEN least <= 5 * d THEN 5 ELSE 10 END AS step FROM s), v AS (SELECT axis, lo, hi, (ceil(lo / step) + k.range) * step AS v FROM t, range(9) k) SELECT axis, round((v - lo) / (hi - lo), 4) AS fraction, rtrim(rtrim(printf('%.2f', v), '0'), '.') AS label FROM v WHERE v <= hi")
def axis_ticks(spark, d):
    names = ("l_quantity", "l_extendedprice", "l_discount")
    ends = _t(spark, d, "lineitem").agg(*[f(c).cast("double") for c in names for f in (F.min, F.max)]).first()
    rows = [(c, round(at, 4), label) for i, c in enumerate(names) for at, label in axes.numeric_ticks(ends[2 * i], ends[2 * i + 1])]
    return spark.createDataFrame(rows, "axis string, fraction double, label string")


@query(f"WITH e AS (SELECT min({_US}) lo, max({_US}) hi FROM events) SELECT round(range / 5.0::DOUBLE, 9) AS fraction, CAST(lo + ((hi - lo) * range + 2) // 5 AS VARCHAR) AS label FROM e, range(6)")
def integer_axis_ticks(spark, d):
    lo, hi = _t(spark, d, "events").agg(F.min(binning.micros(F.col("ts"))), F.max(binning.micros(F.col("ts")))).first()
    return spark.createDataFrame([(round(at, 9), label) for at, label in axes.integer_ticks(lo, hi, 6)], "fraction double, label string")


@query("SELECT n_nationkey::BIGINT AS row_id, printf('%.0f', n_nationkey * 12345.678) AS whole, CASE WHEN n_nationkey = 0 THEN '0' ELSE rtrim(rtrim(printf('%.2f', n_nationkey * 12345.678), '0'), '.') END AS decimal, CASE WHEN n_nationkey = 0 THEN '0' WHEN n_nationkey * 123456.78 >= 1000000 THEN printf('%.1fM', n_nationkey * 123456.78 / 1000000) ELSE printf('%.1fk', n_nationkey * 123456.78 / 1000) END AS compact FROM nation")
def axis_labels(spark, d):
    keys = sorted(r[0] for r in _t(spark, d, "nation").select("n_nationkey").collect())  # 25 rows
    rows = [(k, axes.format_value(k * 12345.678, "integer"), axes.format_value(k * 12345.678), axes.format_value(k * 123456.78, "compact")) for k in keys]
    return spark.createDataFrame(rows, "row_id long, whole string, decimal string, compact string")


@query("WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c FROM nation) SELECT i AS lane, n_name AS label FROM n, range(6) r WHERE i = r.range * (c - 1) // 5")
def lane_label_sample(spark, d):
    names = [r.n_name for r in _t(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    return spark.createDataFrame(axes.sample_labels(names, 6), "lane long, label string")


_PLOTS = ((1920, 1080), (1080, 1920), (2560, 600), (700, 530), (4096, 4096), (1024, 520))


@query(f"WITH p AS (SELECT unnest([{', '.join(str(w) for w, _ in _PLOTS)}]) w, unnest([{', '.join(str(h) for _, h in _PLOTS)}]) h), t AS (SELECT unnest([256, 512, 1024]) short, unnest([262144, 1048576, 4194304]) most), c AS (SELECT w, h, short, 8 * least(CAST(ceil(ceil(short * (greatest(w, h)::DOUBLE / least(w, h)) - 1e-9) / 8) AS BIGINT), most // (short * 8)) AS long FROM p, t WHERE short * 2 <= least(w, h)), b AS (SELECT w, h, max(struct_pack(s := short, l := long)) x FROM c WHERE short * long <= 4194304 GROUP BY w, h) SELECT w::BIGINT AS w, h::BIGINT AS h, CASE WHEN w >= h THEN x.l ELSE x.s END::BIGINT AS width, CASE WHEN w >= h THEN x.s ELSE x.l END::BIGINT AS height FROM b")
def resolution_choice(spark, d):
    return spark.createDataFrame([(w, h, *axes.choose_resolution(w, h)) for w, h in _PLOTS], "w long, h long, width long, height long")


@query("WITH e AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem) SELECT round(x0, 6) AS x_min, round(x1, 6) AS x_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max FROM (SELECT x0 + (x1 - x0) * 0.5 - (x1 - x0) * 0.25 * 0.5 + (x1 - x0) * 0.25 * 0.1 AS x0, x0 + (x1 - x0) * 0.5 + (x1 - x0) * 0.25 * 0.5 + (x1 - x0) * 0.25 * 0.1 AS x1, y0 + (y1 - y0) * 0.5 - (y1 - y0) * 0.25 * 0.5 - (y1 - y0) * 0.25 * 0.2 AS y0, y0 + (y1 - y0) * 0.5 + (y1 - y0) * 0.25 * 0.5 - (y1 - y0) * 0.25 * 0.2 AS y1 FROM e)")
def viewport_zoom_pan(spark, d):
    ends = _t(spark, d, "lineitem").agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    view = axes.Viewport.of(*ends).zoom(0.5, 0.5, 0.25).pan(0.1, -0.2).view
    return spark.createDataFrame([tuple(round(v, 6) for v in view)], "x_min double, x_max double, y_min double, y_max double")
