"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import oracles
from tidewater.llm.fingerprints import edited_likeness
from tidewater.llm.html_extraction import extract
from tidewater.llm.line_dedup import line_report
from tidewater.llm.merkle import tamper_report
from tidewater.llm.mixing import mix
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import pack_documents
from tidewater.llm.periodic_runs import run_report
from tidewater.llm.quality_model import quality
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.sharding import kd_shards
from tidewater.llm.toxicity import toxicity
from tidewater.llm.warc import page_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"), passages=True)


def tokenizer_file() -> str:
    """The public tokenizer of the packing query, installed beside Python's packages."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_report(_table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_fingerprints": op5_fingerprints,
        "op6_html_extraction": op6_html_extraction,
        "op7_quality_model": op7_quality_model,
        "op8_quality_rules": op8_quality_rules,
        "op9_kd_sharding": op9_kd_sharding,
        "op10_source_mixing": op10_source_mixing,
        "op11_warc": op11_warc,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators learn from labels or pages, count bytes or search, which SQL can't express or not in bounded memory; tests hold them to brute force."""
    return {
        "op2_line_dedup": oracles.line_dedup(),
        "op4_near_duplicates": oracles.near_duplicates(),
        "op8_quality_rules": oracles.quality_rules(),
        "op10_source_mixing": oracles.source_mixing(),
        "op11_warc": oracles.warc(),
        "op12_merkle_manifest": oracles.merkle_manifest(),
    }
