"""A corpus pipeline of five stages: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import decontaminate, neardup, packing, secrets, toxicity
from fieldglass.llm.core import materialize, with_possible


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the model learns from the labelled ones among them."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of rows that share the kept doc_id and have words, the first in order of
    their columns stays.  Only rows that may be of an id that is dropped or
    repeated are shuffled; all others stay where they are read.
    """
    found = neardup.near_duplicates(docs)
    ids = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(~F.col("kept")).alias("_gone"), F.count_if(F.col("kept") & (F.col("n_shingles") > 0)).alias("_n"))
    ids = materialize(ids.where("_gone or _n > 1"), "groups")
    marked = with_possible(docs.withColumn("_id", F.col("doc_id").cast("long")), "_id", ids.select("_id"), ids.count(), "_possible")
    asked = materialize(marked.where("_possible").join(ids, "_id", "left").where("_gone is null or not _gone"), "asked")
    first = asked.where("_n > 1").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row")).select("doc_id", "row.*")
    alone = marked.where("not _possible").select(*docs.columns).unionByName(asked.where("_n is null").select(*docs.columns))
    return alone.unionByName(first.select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_overlaps")
    return found.where(F.size("_overlaps") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars counted anew."""
    clean = secrets.redact_secrets(secrets.scan_secrets(docs, out="_secrets"), spans="_secrets")
    return clean.withColumn("n_chars", F.when(F.size("_secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

#: Trained models, connected components and subword ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
