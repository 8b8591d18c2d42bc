"""A corpus pipeline: quality rules, line de-duplication, near-duplicate removal, secret redaction, packing.

Every stage works on all that its predecessor kept; all but the last return the columns of
`documents`.  No stage is expressible in SQL as a whole, so there is no ORACLE_SQL; a test holds the
stages that drop rows or lines against a brute-force version, with null and repeated ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.llm.common import saved, table
from stemforge.llm.line_dedup import dedup_lines
from stemforge.llm.ngram_join import one_of_each
from stemforge.llm.packing import pack_documents
from stemforge.llm.quality_rules import apply_rules
from stemforge.llm.secret_scan import redact_secrets


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do boilerplate lines of the others."""
    return _measured(apply_rules(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first one stays; documents left without a word go."""
    return _measured(dedup_lines(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets give way to a mark."""
    return _measured(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in the sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("secret_scan", secret_scan), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
