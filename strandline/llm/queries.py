"""Queries of this subpackage: one per operator, over whole tables.

``QUERIES`` maps a name to ``f(spark, sf_dir)``; ``ORACLE_SQL`` holds the DuckDB
equivalents of those that SQL can express.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    chat_format,
    fill_in_middle,
    html_blocks,
    importance_resampling,
    license_scan,
    multiprobe_lsh,
    pii_surrogates,
    quality_rules,
    sentencepiece_bpe,
    simhash_pigeonring,
    source_mixing,
    suffix_dedup,
    warc,
)
from strandline.llm._shared import table
from strandline.llm.oracle import ORACLE_SQL  # noqa: F401  the entry module reads it here

#: Text of both turns of the conversation added to op11.
CONTROL_TURN = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; STRANDLINE_TOKENIZERS names another folder."""
    folder = os.environ.get("STRANDLINE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.redact(docs, report=True)


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pigeonring.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.profile(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "left_chars", "n_lines", "n_lines_kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_holds")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe_lsh.nearest(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(CONTROL_TURN)
    # conversation -7 holds only control strings
    added = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat_format.read_back(chat_format.spans(turns.unionByName(added)))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    first = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return made.select(*first, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_html_blocks": op2_html_blocks,
    "op3_simhash_pigeonring": op3_simhash_pigeonring,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_multiprobe_lsh": op9_multiprobe_lsh,
    "op10_source_mixing": op10_source_mixing,
    "op11_chat_format": op11_chat_format,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}
