"""A training corpus from `documents`: quality rules, SimHash near-dedup, secret scans, mixing, best-fit packing.

Every stage takes any rows: null texts, sources, languages and numbers, repeated rows and further columns are handled as its operator's
docstring says, and an empty table gives an empty one.  Rows that share a number are documents of their own in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specforge.llm.common import table, written
from specforge.llm.mixing import mix_documents
from specforge.llm.packing import packed, vocabulary_path
from specforge.llm.quality import quality_filter
from specforge.llm.secrets import redact
from specforge.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go, each row by its own verdict (a null text has no words and goes)."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: the smallest number, null last, ties by place; texts without words stay all."""
    return near_dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; a null text stays null, n_chars follows the text."""
    return redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes their first word, twice at most; those without words never."""
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token."""
    return packed(docs, vocabulary_path(), ranks=vocabulary_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicates by fingerprints and packing by tokens aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
