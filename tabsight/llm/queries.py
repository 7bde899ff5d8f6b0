"""Registered queries of this package: the digest columns that each query's contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .divergence import DIVERGENCE_SQL, divergence
from .html_extract import extract_text
from .line_dedup import line_components
from .mixing import mix
from .negatives import NEGATIVES_SQL, hard_negatives, shifted_label
from .packing import pack
from .pii import pseudonymise
from .quality_cnn import score_documents
from .quality_rules import apply_rules
from .sharding import shard
from .simhash import hex16, simhash_components
from .topk import TOP_K_SQL, top_k


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of the mixture: entropy at 0.95 of its maximum, no source more than four times, each at least once."""
    out = mix(table(spark, sf_dir, "documents"), entropy_share=0.95, max_repeats=4.0)
    return out.select("row.doc_id", "row.source", "tokens", "weight", "epoch", "position")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), "a key for tests and checks").select("doc_id", "text", "n_entities")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "rule")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return out.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=shifted_label(), every=100, scale=256)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_html_extraction": op5_html_extraction,
    "op6_ann_forest": op6_ann_forest,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_decision_list": op9_decision_list,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_divergence": op11_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_top_k": op13_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op11_divergence": DIVERGENCE_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_top_k": TOP_K_SQL,
}
