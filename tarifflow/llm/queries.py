"""One query per operator over its whole table, with comparison SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, collocations, exact_dedup, hnsw, html_main, mixing, packing, quality, repeats, sharding, simhash, toxicity, url_filter
from .oracles import COLLOCATIONS, EXACT_DEDUP, HARD_NEGATIVES, QUALITY, URL_FILTER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_exact_dedup": EXACT_DEDUP, "op3_quality_rules": QUALITY, "op5_url_filter": URL_FILTER, "op12_hard_negatives": HARD_NEGATIVES, "op13_collocations": COLLOCATIONS}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).drop("text")


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, measures=quality.BASE).drop("text")
    failed = (F.col("n_words") < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *quality.BASE, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


@_query
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The tree works on digests of the text: only narrow rows are shuffled.
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "lang", "source", sharding.size_of().alias("size"), crc.alias("text_crc32"), sharding.group_of().alias("group"))
    placed = sharding.place(rows, group="group", size="size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.spam_list(pages)).select("page_id", "host", "path", "rule", "verdict")


@_query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages)


@_query
def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).drop("text")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence_ids", "evidence_terms")


@_query
def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
