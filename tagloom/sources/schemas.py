"""Schemas of the tables and the rules their rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILES = "file_id long, file_name string, pages int, pure_text string, headers string, mentioned_tags string, last_update timestamp_ntz"
PROPERTIES = "prop_id long, external_id string, prop_name_eng string, prop_name_rus string, prop_desc_eng string, prop_desc_rus string, search_condition string, alt_keywords string, desc_for_llm string, flag int, last_update timestamp_ntz"
# fixed values: how a property may be searched
CONDITIONS = ["none", "search_in_header", "only_if_mentioned"]
# fixed values: what a missing value of a column means, and which columns name a row
DEFAULTS = {"files": {"mentioned_tags": ""}, "properties": {"external_id": "none", "prop_desc_eng": "none", "prop_desc_rus": "none", "search_condition": "none", "alt_keywords": "none", "flag": 0}}
UNIQUE = {"files": ["file_name"], "properties": ["external_id", "prop_name_eng"]}


def rules(table: str) -> dict[str, Column]:
    """What each row of files or properties must keep, by the rule's name; a null in a rule counts as kept unless the rule is about nulls."""
    if table == "files":
        return {"pages_positive": F.col("pages") > 0, "name_given": F.col("file_name").isNotNull(), "text_given": F.col("pure_text").isNotNull()}
    return {"condition_known": F.col("search_condition").isin(CONDITIONS), "name_given": F.col("prop_name_eng").isNotNull()}


def violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """(key, rule) of every broken rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules(table).items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the values of a unique column that stand in several rows; nulls don't count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def conforming(df: DataFrame, table: str, key: str) -> DataFrame:
    """The rows of files or properties as the table takes them: defaults for missing values, no broken rule, and of the rows that share a unique value the one with the least key.

    Unique columns are gone over in their order. A default is no value and may repeat.
    """
    out = df.fillna({c: v for c, v in DEFAULTS[table].items() if c in df.columns})
    for ok in rules(table).values():
        out = out.filter(F.coalesce(ok, F.lit(True)))
    for c in UNIQUE[table]:
        if c in df.columns:
            default = F.col(c) == F.lit(DEFAULTS[table].get(c)).cast("string")
            same = F.named_struct(F.lit("value"), F.when(F.coalesce(default, F.lit(False)), F.lit(None)).otherwise(F.col(c)), F.lit("key"), F.when(default, F.col(key)))
            out = out.withColumn("__n", F.row_number().over(Window.partitionBy(same).orderBy(key))).filter("__n = 1").drop("__n")
    return out
