"""From raw documents to tokens: quality, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes what the one before it kept, written as Parquet and read again, so a lost executor costs one stage at most.  All stages but
the last return the columns of ``documents``; a text that loses lines has its ``n_chars`` counted again where there is such a column.

Defined results: an empty table passes through all stages; null texts are rejected by the first one (no words); what each stage does with
nulls in other columns, ties and repeated rows is said with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, line_dedup, minhash, quality
from tidemark.session import materialise

#: Similarity of word shingles from which the stage takes texts for one; op1 as a query has its own.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose likelihood ratio reaches the threshold; the model is fitted on ``docs``."""
    return quality.keep(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, equal or one word apart, earlier in the corpus."""
    return line_dedup.dedup_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of a similarity of ``NEAR_PERCENT`` or more, that with the smallest id."""
    return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark stands."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its id, the number and digest of its tokens, and the digest of what they decode to."""
    return bpe.report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", tokenise),
]

#: SQL has no tokens, sketches or fitted models; tests hold every stage against its operator's brute-force model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
