"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate as _leaks
from spindrift.llm import html_text as _html
from spindrift.llm import jaccard_join as _jaccard
from spindrift.llm import language as _language
from spindrift.llm import line_dedup as _lines
from spindrift.llm import packing as _packing
from spindrift.llm import pii as _pii
from spindrift.llm import quality_classifier as _quality
from spindrift.llm import quality_rules as _rules
from spindrift.llm import toxicity as _toxicity
from spindrift.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.digest(_pii.pii(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _lines.apply_bitmaps(docs, _lines.line_dedup(docs), digest=True)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.html_text(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality_classifier(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_packing.token_pieces(table(spark, sf_dir, "documents")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _leaks.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("hits", lambda h: h["item_id"]))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"), F.transform("hits", lambda h: h["edits"].cast("bigint")).alias("edits"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_line_dedup,
        op3_ngram_jaccard_join,
        op4_language_id,
        op5_html_extraction,
        op6_quality_classifier,
        op7_toxicity,
        op8_quality_rules,
        op9_best_fit_packing,
        op10_benchmark_decontamination,
    )
}

ORACLES = {"op2_line_dedup": _lines.ORACLE_SQL, "op3_ngram_jaccard_join": _jaccard.ORACLE_SQL, "op8_quality_rules": _rules.oracle_sql()}
