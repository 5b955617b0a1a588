"""Registered queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retort.llm import bpe, language, overlap, packing, terms
from retort.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "labels_tsv"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_coverage(table(spark, d, "labels_tsv"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "labels_tsv"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "cs_log"), "cs_id", "cs_string")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marked = _terms(spark, d).filter("mark IS NOT NULL")
    return marked.selectExpr("term AS token", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).selectExpr("term AS token", "occurrences", "records", "n_records", "mark")


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(_packed(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "documents"), table(spark, d, "languages"))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.page_languages(table(spark, d, "documents"), table(spark, d, "languages")).drop("lang_label")


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), table(spark, d, "languages"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_coverage, p1_report, p3_found, p3_terms, p5_ids, p6_found, p6_containers, p6_report, p7_found, p7_languages, p7_segments]
    return {q.__name__: q for q in found}


_TERMS = r"""
WITH once AS (SELECT cs_id, max(cs_string) AS s FROM cs_log WHERE cs_id IS NOT NULL GROUP BY cs_id),
words AS (SELECT cs_id, unnest(string_split_regex(s, '[ \t\r\n]+')) AS token FROM once),
counted AS (SELECT token, count(*) AS occurrences, count(DISTINCT cs_id) AS records FROM words WHERE token <> '' GROUP BY token),
total AS (SELECT count(*) AS n_records FROM once),
terms AS (SELECT token, occurrences, records, n_records,
  CASE WHEN records < 3 THEN 'rare' WHEN records > n_records * 0.5 THEN 'common' END AS mark FROM counted, total)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + "SELECT token, mark FROM terms WHERE mark IS NOT NULL",
        "p3_terms": _TERMS + "SELECT token, occurrences, records, n_records, mark FROM terms",
    }
