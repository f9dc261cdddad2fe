"""Queries of the problems on texts (1, 4, 6 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, canonical, encoding, glyphs, language, leakage, ocr
from tagloom.session import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_lines(spark, sf_dir).select("doc_id", "line_no")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.free_entries(*(table(spark, sf_dir, n) for n in ("register", "properties", "validations", "allowed_items")), canonical.known_names(spark))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(spark, table(spark, sf_dir, "files"), table(spark, sf_dir, "file_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.to_relabel(p4_languages(spark, sf_dir))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.fixed_places(table(spark, sf_dir, "files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_places(spark, sf_dir).select("file_id", "field", "place")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repairs(spark, table(spark, sf_dir, "files"))


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.readable(spark, table(spark, sf_dir, "files"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_languages, p6_found, p6_places, p7_found, p7_paragraphs, p8_ids, p9_found, p10_found, p10_lines)}
