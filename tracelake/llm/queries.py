"""The opN_ queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, bpe, decontamination, embedding_dedup, hard_negatives, language_id, license_scan, ngram_join, sharding, substring_dedup, toxicity, url_filter, warc
from .common import Scratch, delete, fresh_path, read, table
from .oracles import ORACLES  # noqa: F401


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_earlier_passages(read(spark, sf_dir, "documents"))


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, folds=5, held=0))
    return out.select("doc_id", F.coalesce(language_id.fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), folds=4, held=2))
    return out.select("doc_id", F.coalesce(language_id.fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted")


def op2_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    # a page has the label of the document of the same number; it is to be blocked if toxic or of low quality
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    labelled = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("blocked")), "page_id")
    return url_filter.judge(pages, url_filter.mine(labelled))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    passing, folder = Scratch(spark), fresh_path(spark, "warc")
    manifest = warc.write_archives(pages, folder, scratch=passing)
    records = table(warc.read_archives(spark, manifest), "warc-records")
    passing.drop()
    delete(spark, folder)
    out = warc.resolve(records, pages)
    kind = pages.schema["page_id"].dataType
    return out.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), lambda i: i % 50 == 0)


def op13_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_winnowing_decontamination": op5_winnowing_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op7_ppm_language_id": op7_ppm_language_id,
    "op4_nnpu_toxicity": op4_nnpu_toxicity,
    "op2_url_association_rules": op2_url_association_rules,
    "op3_warc_salvage": op3_warc_salvage,
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op9_substring_dedup": op9_substring_dedup,
    "op6_stratified_shards": op6_stratified_shards,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_license_scan": op11_license_scan,
    "op12_bit_sliced_negatives": op12_bit_sliced_negatives,
    "op13_ball_tree_clusters": op13_ball_tree_clusters,
}

