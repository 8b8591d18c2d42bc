"""The queries of this subpackage for __spark_entry__.py, with their SQL where SQL can express them.

They apply the operators, with production parameters, to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.llm.ann_search import nearest
from stemforge.llm.bpe_automaton import encode_documents
from stemforge.llm.common import table
from stemforge.llm.language_id import fit_language_model, identify_language
from stemforge.llm.license_scan import digest, scan_licenses
from stemforge.llm.line_dedup import report as line_report
from stemforge.llm.ngram_join import join_ngrams
from stemforge.llm.packing import pack_documents
from stemforge.llm.quality_rules import ORACLE as QUALITY_ORACLE
from stemforge.llm.quality_rules import judge
from stemforge.llm.secret_scan import scan_secrets
from stemforge.llm.source_divergence import ORACLE as DIVERGENCE_ORACLE
from stemforge.llm.source_divergence import source_divergence
from stemforge.llm.token_alignment import align_documents
from stemforge.llm.toxicity import fit_toxicity_model, score_toxicity
from stemforge.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("removed_lines")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"))


def _fold(modulus: int, value: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == value


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~_fold(4, 2)))
    return identify_language(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity_model(docs, labels.where(~_fold(5, 0)))
    return score_toxicity(docs, model).select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted", "difference")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_secret_scan, op2_quality_rules, op3_line_dedup, op4_bpe_automaton, op5_ngram_join, op6_language_id, op7_ann_search,
        op8_toxicity, op9_packing, op10_url_filter, op11_token_alignment, op12_license_scan, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_ORACLE, "op13_source_divergence": DIVERGENCE_ORACLE}
