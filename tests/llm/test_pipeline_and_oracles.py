"""The registered queries against their SQL, and the pipeline against its stages' laws."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import neardup
from fieldglass.llm.core import possible, with_possible
from fieldglass.llm.oracles import ORACLES
from fieldglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    order = sorted(ours.columns)
    assert order == sorted(names)
    a = sorted(tuple(str(r[c]) for c in order) for r in ours.collect())
    b = sorted(tuple(str(r[names.index(c)]) for c in order) for r in theirs.fetchall())
    assert a == b


def test_every_operator_has_one_query():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in QUERIES


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.schema == docs.schema
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean & kept["toxicity"]) >= 0.98 * len(clean) and len(toxic & kept["toxicity"]) < len(toxic)
    leaks = {r.doc_id for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert not leaks & kept["decontamination"] and kept["decontamination"] == kept["near_dedup"] - leaks
    assert kept["secrets"] == kept["decontamination"]
    assert before.where(F.col("text").rlike("[0-9a-f]{32,}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["secrets"]
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_on_an_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.count() == 0


def test_pipeline_keeps_nulls_and_one_of_each_group(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "de", "t", 13), (4, "a b c d e f g", "de", "t", 13), (5, "h i j k l m n", "de", "t", 13), (5, "h i j k l m n", "de", "t", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 5]


def test_near_duplicates_leave_without_a_shuffle_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at_most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}
        assert {r.doc_id for r in out.collect()} == kept and len(kept) < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at_most)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_rows_ruled_out_by_a_bitmap_of_keys_have_no_such_key(spark):
    rows = spark.range(-5_000, 45_000).unionByName(spark.createDataFrame([(None,), (1 << 62,), (7,)], "id long"))
    for n, step in ((0, 1), (1, 1), (3_000, 7)):
        wanted = spark.range(n).select((F.col("id") * step - 100).alias("k"))
        found = possible(rows, "id", wanted, n)
        exact = rows.join(wanted, rows.id == wanted.k, "left_semi")
        assert found.join(wanted, F.col("id") == F.col("k"), "left_semi").count() == exact.count() >= n
        assert found.count() <= exact.count() + rows.count() / 8
    assert with_possible(rows, "id", wanted, n, "p").count() == rows.count()
