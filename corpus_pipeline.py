"""From raw documents to token ids: five stages, each one operator of ``strandline.llm``.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; its output is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; further columns, whatever their names, pass through.

Defined cases.  A null or empty text has too few words, so the first stage drops
it; given to a later stage it is kept, as one near-duplicate class, without
personal data, taken zero times by the mix, with no ids.  Rows that repeat an id
are rows of their own: of near-duplicate ones the largest stays, and the mix takes
each as often as that id on average.  Rows without an id are kept unless their
class has one; a class without any keeps its largest row.  Long texts are treated
whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import pii_surrogates, quality_rules, sentencepiece_bpe, simhash_pigeonring, source_mixing
from strandline.llm._shared import cut, table
from strandline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rules or lose too much text."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: classes link texts of Jaccard similarity 0.8 or more on five-word shingles."""
    return simhash_pigeonring.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return pii_surrogates.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII surrogates", pii),
    ("mixing sources", mixing),
    ("SentencePiece encoding", tokenize),
]

#: Token ids, fingerprints and surrogates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else cut(out, f"stage-{k}")
    return docs
