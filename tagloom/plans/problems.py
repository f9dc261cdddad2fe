"""Queries of the general problems 2, 3 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators import units, unpack, widen
from tagloom.session import table


def p2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.common_units(spark, *(table(spark, sf_dir, n) for n in ("register", "properties", "validations", "allowed_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.converted(p2_units(spark, sf_dir), table(spark, sf_dir, "allowed_items"))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen.wide_table(spark, *(table(spark, sf_dir, n) for n in ("register", "properties", "tags")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen.filled(p3_wide(spark, sf_dir), table(spark, sf_dir, "properties"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack.several(unpack.unpack(table(spark, sf_dir, "files"), table(spark, sf_dir, "properties")))


QUERIES = {f.__name__: f for f in (p2_found, p2_units, p3_found, p3_wide, p5_found)}
