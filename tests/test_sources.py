import json
import os
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import fields
from fieldglass.operators.selection import lowest_rows
from fieldglass.plans.evidence import Evidence, decode, escape_cell, evidence_of, redact_path, write_bundle, write_intervals
from fieldglass.sources import keys, profiles, readers, synthetic
from fieldglass.streaming.timeline import streaming_density, windowed_lanes

M = 2**64 - 1


@pytest.fixture
def scatter_csv(tmp_path):
    p = tmp_path / "s.CSV"
    p.write_text("latency_ms,payload_size,label\n10.5,512,a\n20,1024,b\n")
    return str(p)


def test_csv_scatter(spark, scatter_csv):
    d = readers.load_scatter(spark, scatter_csv, "latency_ms", "payload_size")
    assert d.x_range == (10.5, 20.0) and d.y_range == (512.0, 1024.0) and d.count == 2
    assert [r.row_id for r in d.rows.orderBy("row_id").collect()] == [0, 1]
    assert readers.load_scatter(spark, scatter_csv, "latency_ms", "payload_size", 1).count == 1
    assert readers.table_schema(spark, scatter_csv)[1:] == [("payload_size", "Integer"), ("label", "String")]
    with pytest.raises(ValueError, match="label"):
        readers.load_scatter(spark, scatter_csv, "latency_ms", "label")
    with pytest.raises(ValueError, match="nope"):
        readers.load_scatter(spark, scatter_csv, "nope", "label")
    with pytest.raises(ValueError):
        readers.read_table(spark, scatter_csv, 0)
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.json")


def test_csv_timeline(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("timestamp,provider\n100,zeta\n125,alpha\n150,zeta\n160,beta\n")
    d = readers.load_timeline(spark, str(p), "timestamp", "provider")
    assert d.labels == ("zeta", "alpha", "beta") and d.x_range == (100, 160)
    assert [r.lane for r in d.rows.orderBy("row_id").collect()] == [0, 1, 0, 2]
    p2 = tmp_path / "u.csv"
    p2.write_text("timestamp,provider\n-5,a\n")
    with pytest.raises(ValueError, match="timestamp"):
        readers.load_timeline(spark, str(p2), "timestamp", "provider")
    p3 = tmp_path / "v.csv"
    p3.write_text("timestamp,provider\n5, \n6,a\n")
    with pytest.raises(ValueError, match="provider"):
        readers.load_timeline(spark, str(p3), "timestamp", "provider")


def test_row_ids_are_dense_over_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(100).repartition(7).write.parquet(path)
    ids = sorted(r.row_id for r in readers.read_table(spark, path).collect())
    assert ids == list(range(100))
    assert readers.read_table(spark, path, 10).count() == 10
    assert sorted(r.row_id for r in readers.number_rows(spark.read.parquet(path)).collect()) == list(range(100))
    assert readers.cell_at(readers.read_table(spark, path), 0, "id") is not None
    with pytest.raises(KeyError):
        readers.cell_at(readers.read_table(spark, path), 1000, "id")


def test_frames(spark):
    pdf = pd.DataFrame({"x": [1, 2], "y": [0.5, 1.5], "c": ["a", None]})
    assert readers.from_frame(spark, pdf, ("x", "y")).count() == 2
    assert readers.from_frame(spark, pa.Table.from_pandas(pdf)).columns == ["x", "y", "c"]
    with pytest.raises(ValueError, match="z"):
        readers.from_frame(spark, pdf, ("z",))
    with pytest.raises(ValueError, match="flat"):
        readers.from_frame(spark, spark.range(1).select(F.array("id").alias("a")))
    with pytest.raises(ValueError):
        readers.check_flat_schema(spark.range(1).select("id", "id").schema)
    assert readers.source_text(spark.createDataFrame(pdf)).orderBy("x").collect()[1].c in ("", "NaN")


def test_keys(spark):
    df = spark.createDataFrame([(0, "a"), (1, " b "), (2, "b"), (3, "c")], "row_id long, k string")
    with pytest.raises(ValueError, match="rows 1 and 2"):
        keys.validate_key(df, "k", "row_id")
    good = df.where("row_id != 2")
    keys.validate_key(good, "k", "row_id", 99)
    with pytest.raises(ValueError, match="bytes"):
        keys.validate_key(good, "k", "row_id", 98)
    with pytest.raises(ValueError, match="blank"):
        keys.validate_key(df.withColumn("k", F.lit(" ")), "k", "row_id")
    with pytest.raises(ValueError):
        keys.validate_key(df, "nope", "row_id")


class Rng:
    """The generator one draw after another."""

    def __init__(self, seed):
        self.s = seed

    def next(self):
        self.s = (self.s + 0x9E3779B97F4A7C15) & M
        z = self.s
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M
        return z ^ (z >> 31)


def test_synthetic_points(spark):
    n, seed = 400, 21
    rows = synthetic.synthetic_points(spark, n, seed).orderBy("row_id").collect()
    assert [sum(r.kind == k for r in rows) for k in ("cluster", "background", "outlier")] == [280, 100, 20]
    rng = Rng(seed)
    unit = lambda: (rng.next() >> 40) / (1 << 24)
    for r in rows:
        if r.kind == "cluster":
            x, y = (c + (sum(unit() for _ in range(3)) / 3 - 0.5) * 10 for c in (28, 72))
        elif r.kind == "background":
            x, y = unit() * 100, unit() * 100
        else:
            side = rng.next() % 4
            a, b = unit() * 2, unit() * 2
            x, y = (a if side in (0, 2) else 100 - a), (b if side in (0, 1) else 100 - b)
        assert abs(r.x - x) < 1e-4 and abs(r.y - y) < 1e-4


def test_a_limit_reads_only_the_first_files(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(0, 1_000, numPartitions=10).withColumnRenamed("id", "v").write.parquet(path)
    for limit in (1, 100, 101, 5_000):
        some = readers.read_table(spark, path, limit)
        got = sorted((r.row_id, r.v) for r in some.collect())
        assert got == sorted((r.row_id, r.v) for r in readers.read_table(spark, path).collect())[:limit]
        assert len(some.inputFiles()) == min(10, -(-limit // 100))


def test_numbering_rows_shuffles_counts_of_files_only(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(0, 1_000, numPartitions=3).withColumnRenamed("id", "v").write.parquet(path)
    at_most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (readers.read_table(spark, path), readers.read_table(spark, path, 400), readers.number_parquet_rows(spark.read.parquet(path), "n")):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r[0] for r in rows.collect()) == list(range(rows.count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at_most)


def test_ids_are_counted_exactly_by_words(spark):
    ids = [*range(-130, 400), 7, 7, None, 63, 64, (1 << 62) + 5, -(1 << 62), 5_000_000_000]
    rows = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "row_id long, v double")
    got = readers.aggregate_with_ids(rows, "row_id", n=(F.count(F.lit(1)), F.sum), most=(F.max("v"), F.max)).first()
    assert (got.n, got.most, got.ids) == (len(ids), len(ids) - 1.0, len(set(ids) - {None}))
    assert readers.aggregate_with_ids(rows.limit(0), "row_id").first().ids == 0


def test_bound_scatter_rows_never_meet_by_id(spark):
    from fieldglass.queries import QUERIES

    plan = QUERIES["scatter_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "hashpartitioning(row_id" not in plan


def test_synthetic_tables_plan_at_once_under_filters_bins_and_joins(spark):
    points, events = synthetic.synthetic_points(spark, 2_000), synthetic.synthetic_events(spark, 2_000)
    grid = fields.binned(points, F.col("x").cast("double"), F.col("y").cast("double"), (0.0, 100.0, 0.0, 100.0), 64, 64)
    for df in (points.where("x > 1 and y < 99"), grid, events.where("ts > 10 and value > 6"), points.where("x > 1").join(events.where("lane < 7"), "row_id")):
        began = time.perf_counter()
        df._jdf.queryExecution().optimizedPlan().toString()
        assert time.perf_counter() - began < 5
    assert fields.density(grid).agg(F.sum("n")).first()[0] == 2_000


def test_synthetic_events(spark):
    n, seed = 400, 33
    rows = synthetic.synthetic_events(spark, n, seed).orderBy("row_id").collect()
    assert not any(220 <= r.ts <= 280 and r.kind == "background" for r in rows)
    rng = Rng(seed)
    unit = lambda: (rng.next() >> 40) / (1 << 24)
    for r in rows:
        if r.kind == "background":
            early = rng.next() % (220 + 720) < 220
            ts = rng.next() % 220 if early else 281 + rng.next() % 720
            lane, value = rng.next() % 7, 5 + unit() * 20
        elif r.kind == "spike":
            ts, lane, value = 460 + rng.next() % 41, rng.next() % 7, 15 + unit() * 20
        elif r.kind == "stale_lane":
            ts, lane, value = rng.next() % 121, 7, 4 + unit() * 14
        else:
            lane, ts, value = rng.next() % 4, 760 + rng.next() % 61, 80 + unit() * 40
        assert (r.ts, r.lane) == (ts, lane) and abs(r.value - value) < 1e-4
    with pytest.raises(ValueError):
        synthetic.synthetic_events(spark, 10, lanes=1)
    with pytest.raises(ValueError):
        synthetic.synthetic_events(spark, 10, time=(230, 260))


def test_profiles_and_sessions(tmp_path, scatter_csv):
    with pytest.raises(ValueError) as e:
        profiles.GAMES.validate([("created_at", "Integer"), ("winner", "Float")])
    assert "white_rating" in str(e.value) and "winner is Float" in str(e.value)
    assert profiles.GAMES.hints([("winner", "String"), ("eco", "Unsupported")]) == ["winner"]
    target = str(tmp_path / "session.json")
    profiles.csv_session(scatter_csv, "numeric_pair", {"x": "latency_ms", "y": "payload_size"}, target, evidence_key="label")
    s = profiles.load_session(target)
    assert s.columns["x"] == "latency_ms" and s.evidence_key == "label"
    (tmp_path / "old.json").write_text(json.dumps({"version": 1, "view": "scatter", "source": "a.csv", "columns": {"x": "a", "y": "b"}}))
    assert profiles.load_session(str(tmp_path / "old.json")).view == "numeric_pair"
    with pytest.raises(ValueError):
        profiles.Session("http://x/a.csv", "numeric_pair", {"x": "a", "y": "b"})
    with pytest.raises(ValueError):
        profiles.Session("a.csv", "time_value", {"x": "a"})


def test_evidence(spark, tmp_path):
    df = spark.range(50).withColumn("included", F.col("id") < 40)
    e = evidence_of(df, F.col("id") % 2 == 0, "id", "/data/a|b.csv", "density", {"x": "a"}, {"policy": "exclude"}, {"domain": [0, 1]}, keep=5)
    assert (e.total_rows, e.included_rows, e.selected_rows, e.row_ids, e.sampled) == (50, 40, 20, (0, 2, 4, 6, 8), True)
    assert decode(e.to_json().encode()) == e
    assert "a\\|b.csv" in e.to_markdown() and "/data" not in e.to_markdown()
    folder = write_bundle(str(tmp_path / "out"), e)
    assert sorted(os.listdir(folder)) == ["evidence.json", "evidence.md", "manifest.json", "visual-context.txt"]
    assert len(os.listdir(tmp_path / "out")) == 1
    with pytest.raises(ValueError):
        Evidence("a", "density", {}, {}, {}, 1, 2, 0, ())
    with pytest.raises(ValueError):
        decode(b" " * ((8 << 20) + 1))
    with pytest.raises(ValueError):
        decode(b'{"version": 99}')
    assert escape_cell("a|b\n<c>") == "a\\|b &lt;c&gt;" and redact_path("/x/y.csv") == "y.csv"
    write_intervals(spark.createDataFrame([(1, 2)], "start long, end long"), str(tmp_path / "iv"))
    assert lowest_rows(df, "id", 3).count() == 3


def test_streaming_counts_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "event_id")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    lane = F.pmod(F.col("event_id"), F.lit(4)).cast("int")
    q = streaming_density(stream, F.col("user_id"), lane, (0, 1000), 4, 10, 4).writeStream.outputMode("complete").format("memory").queryName("dens").start()
    q.processAllAvailable()
    q.stop()
    batch = streaming_density(ev, F.col("user_id"), lane, (0, 1000), 4, 10, 4)
    assert sorted(map(tuple, spark.table("dens").collect())) == sorted(map(tuple, batch.collect()))
    w = windowed_lanes(stream, "ts", "event_type").writeStream.outputMode("update").format("memory").queryName("lanes").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("lanes").agg(F.sum("n")).first()[0] == ev.count()
