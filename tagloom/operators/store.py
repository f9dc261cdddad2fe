"""Keyed tables: upserts, first-wins, validation lists, property dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import broadcast_if_small, cut


def upsert(old: DataFrame, new: DataFrame, key: str, id_: str, columns: list[str], stamp: str | None = None) -> DataFrame:
    """The table after new rows replaced old ones of the same key and the rest was added with ids that go on from the largest.

    With stamp, a column of old, rows that are new or replaced get the current time in it. One full outer join on the
    key; of several new rows with one key the last in order of the columns wins. New ids are
    given in order of the key.
    """
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in columns))
    fresh = new.filter(F.col(key).isNotNull()).select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.row_number().over(w).alias("__n")).filter("__n = 1").drop("__n").withColumn("__new", F.lit(True))
    both = old.select(id_, key, *columns, *([stamp] if stamp else [])).join(fresh, key, "full_outer")
    top = old.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    taken = F.coalesce("__new", F.lit(False))
    kept = both.filter(F.col(id_).isNotNull())
    numbers = _numbered(fresh.join(old.select(key), key, "left_anti").select(key), key)
    added = both.filter(F.col(id_).isNull()).join(numbers, key).withColumn(id_, F.col("__r") + F.lit(top))
    stamped = [F.when(taken, F.current_timestamp().cast(old.schema[stamp].dataType)).otherwise(F.col(stamp)).alias(stamp)] if stamp else []
    out = lambda d: d.select(F.col(id_), key, *(F.when(taken, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns), *stamped)
    return out(kept).unionByName(out(added))


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """Keys with consecutive numbers from 1 in their order, without one task for all.

    The sorted ranges are cut from their lineage before they are counted, so that a range computed anew, or merged at
    run time, can't change the numbers; counts of the ranges are added up.
    """
    spread = cut(keys.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    local = spread.withColumn("__i", F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33))
    sizes = local.groupBy("__p").agg((F.max("__i") + 1).alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))  # one row a partition
    return local.join(before, "__p").select(key, (F.col("__before") + F.col("__i") + 1).alias("__r"))


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(added, updated): what an upsert does to the table."""
    known = old.select(key).distinct().withColumn("__old", F.lit(1))
    return new.filter(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left").agg(F.count_if(F.col("__old").isNull()).alias("added"), F.count_if(F.col("__old").isNotNull()).alias("updated"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def allowed_lists(validations: DataFrame, allowed: DataFrame) -> DataFrame:
    """(prop_id, target_col, items): the items of the list of each governed cell, in order, joined by |."""
    items = allowed.groupBy("list_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "item"))), lambda x: x["item"]), "|").alias("items"))
    return validations.join(broadcast_if_small(items), "list_name").select("prop_id", "target_col", "items")


def enriched(rows: DataFrame, in_header: DataFrame, if_mentioned: DataFrame, keywords: DataFrame, flags: DataFrame, hints: DataFrame) -> DataFrame:
    """Rows with prop_name_eng plus how their property is searched: search_condition, alt_keywords, flag, desc_for_llm.

    in_header and if_mentioned have name; keywords name, alt_keywords; flags name; hints name, desc_for_llm. A search
    in the header goes before a mere mention; without an entry the defaults are none, none, 0 and an empty hint. Names
    count once, the first in order of the value where they repeat.
    """
    named = lambda d, c, v: d.groupBy(F.col("name").alias("prop_name_eng")).agg(F.min(v).alias(c))
    yes = F.lit(True)
    out = rows
    for d, c, v in ((in_header, "__h", yes), (if_mentioned, "__m", yes), (keywords, "__k", "alt_keywords"), (flags, "__f", yes), (hints, "__d", "desc_for_llm")):
        out = out.join(named(d, c, v), "prop_name_eng", "left")
    condition = F.when(F.col("__h"), "search_in_header").when(F.col("__m"), "only_if_mentioned").otherwise("none")
    return out.select(*rows.columns, condition.alias("search_condition"), F.coalesce("__k", F.lit("none")).alias("alt_keywords"), F.when(F.col("__f"), 1).otherwise(0).alias("flag"), F.coalesce("__d", F.lit("")).alias("desc_for_llm"))


def keyword_list(c: Column) -> Column:
    """The keywords of a semicolon list, trimmed, empty ones left out; none and null have none."""
    pieces = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNotNull() & (c != "none"), pieces)


def prepared(register: DataFrame) -> DataFrame:
    """(row_id, tag, name_eng, name_rus): the register's rows with a tag, E- before it cut off; names with hyphens for dots and without notes in brackets."""
    name = lambda c: F.regexp_replace(F.translate(c, ".", "-"), r"\([^()]*\)", "")
    rows = register.filter("trim(tag_number) != ''")
    return rows.select("row_id", F.regexp_replace(F.trim("tag_number"), "^E-", "").alias("tag"), name(F.col("property_name")).alias("name_eng"), name(F.col("property_name_rus")).alias("name_rus"))


def dump_rows(dumps: DataFrame) -> DataFrame:
    """Rows of a property dump (id, names, comments as structs of EN and RU) that have both names and an id that is no link."""
    ok = (F.length("names.EN") > 0) & (F.length("names.RU") > 0) & ~F.col("id").contains(".ru") & ~F.col("id").contains(".org") & F.col("id").contains("-")
    both = F.col("comments.EN").isNotNull() & F.col("comments.RU").isNotNull()
    return dumps.filter(ok).select(
        F.col("id").alias("external_id"), F.col("names.EN").alias("prop_name_eng"), F.col("names.RU").alias("prop_name_rus"),
        F.when(both, F.col("comments.EN")).otherwise("none").alias("prop_desc_eng"), F.when(both, F.col("comments.RU")).otherwise("none").alias("prop_desc_rus"),
    )
