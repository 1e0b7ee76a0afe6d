"""The queries of the training-data operators, with their fixed result shapes, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, media, neardup, packing, scoring, secrets, sharding, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the mixture of word counts and a causal attention network."""
    return scoring.score_texts(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit audio, read back and turned into log-mel features."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.audio_digest(media.audio_columns(docs)).select("doc_id", "digest.*")


#: The rules of the URL contract.
URL_RULES = (
    urls.UrlRule("block", "com", "/en/"),
    urls.UrlRule("allow", "example.com", "/en/7"),
    urls.UrlRule("allow", "net", "/de/"),
    urls.UrlRule("block", "example.net", "/de/8"),
    urls.UrlRule("block", "org", "/es/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, and by the language-model ratio where none fits."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("mean_ratio", 6).alias("mean_ratio"))


def _learnable(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by noisy-or over its sentences."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), _learnable(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, model)
    held_out = F.coalesce(~_learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SHARDS = 24


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by rendezvous hashing of doc_id, with a slot in each shard."""
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard_records(sized, "doc_id", [1.0] * SHARDS, "shard", grown="grown_shard")
    numbered = sharding.add_slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carry a benchmark passage: one row for each document and item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", F.col("o.item").alias("item_id"), "o.doc_start", "o.item_start", "o.matched", "o.aligned")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html.extract_text(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and spans."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of four-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1,024 tokens, with lexical neighbours."""
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_media_columns": op2_media_columns,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scans": op8_secret_scans,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}
