"""The subpackage's queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, exact_dedup, filter_audit, licenses, media, mixing, near_dedup, prefix_trie, sampled_segmentation, sharding, substring_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_sampled_segmentation(spark, sf_dir):
    return sampled_segmentation.sample_segmentations(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark, sf_dir):
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    digests = chat_format.read_back(chat_format.format_turns(talks.unionByName(chat_format.hostile(talks))))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_components(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan_licenses(licenses.document_paths(_table(spark, sf_dir, "documents")))


def op10_source_mix(spark, sf_dir):
    mixed = mixing.mix_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_sampled_segmentation, op3_substring_dedup, op4_exact_dedup, op5_media_columns,
        op6_token_counts, op7_chat_format, op8_near_dedup, op9_license_scan, op10_source_mix,
        op11_filter_audit, op12_sharding, op13_prefix_trie,
    )
}

ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_chat_format": chat_format.ORACLE, "op10_source_mix": mixing.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_sharding": sharding.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
