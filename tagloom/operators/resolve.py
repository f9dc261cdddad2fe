"""Which property and which registry tag a register row means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import name_key, tag_key
from tagloom.session import broadcast_if_small, cut

MANY_PAIRS = 200_000


def _shortened(c: Column) -> Column:
    """The text itself and every text with one character left out."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, cuts).otherwise(F.array().cast("array<string>"))))


def name_pairs(register: DataFrame, properties: DataFrame) -> DataFrame:
    """(property_name, property_name_rus, prop_id): each distinct pair of typed names of the register and the property that the English, else the Russian one stands for.

    Names equal to the dictionary's but for case, spaces, underscores and notes in brackets are found by a join on
    the key; of the rest every distinct name is matched through texts with one character left out (an equi-join that
    finds all names one insertion, deletion, substitution or swap away) and the nearest dictionary name wins, ties
    by prop_id. Pairs that stand for nothing are left out. The dictionary is a fixed table. Only the two name columns
    are read, once; what was found is cut from its lineage, as the register is joined to it.
    """
    typed = register.select("property_name", "property_name_rus").distinct()
    pairs = cut(typed.select("*", name_key(F.col("property_name")).alias("__en"), name_key(F.col("property_name_rus")).alias("__ru")))
    p = properties.select("prop_id", F.explode(F.array(name_key(F.col("prop_name_eng")), name_key(F.col("prop_name_rus")))).alias("key"))
    names = broadcast_if_small(p.filter("key is not null and key not in ('', 'none')").groupBy("key").agg(F.min("prop_id").alias("prop_id")))
    known = (
        pairs.join(names.select(F.col("key").alias("__en"), F.col("prop_id").alias("__p1")), "__en", "left")
        .join(names.select(F.col("key").alias("__ru"), F.col("prop_id").alias("__p2")), "__ru", "left")
        .select("property_name", "property_name_rus", F.coalesce("__p1", "__p2").alias("prop_id"), F.coalesce(F.when(F.length("__en") > 3, F.col("__en")), F.col("__ru")).alias("__name"))
    )
    open_ = known.filter("prop_id is null and length(__name) > 3").select("__name").distinct()
    near = broadcast_if_small(names.select("key", "prop_id", F.explode(_shortened(F.col("key"))).alias("cut")), 200_000)
    matched = open_.select("__name", F.explode(_shortened(F.col("__name"))).alias("cut")).join(near, "cut").groupBy("__name").agg(F.min_by("prop_id", F.struct(F.levenshtein("__name", "key"), "prop_id")).alias("__p3"))
    return known.join(matched, "__name", "left").select("property_name", "property_name_rus", F.coalesce("prop_id", "__p3").alias("prop_id")).filter("prop_id is not null")


def with_property(register: DataFrame, properties: DataFrame, keep: list[str], about: DataFrame | None = None) -> DataFrame:
    """Rows of the register with the prop_id that their names stand for; columns keep + prop_id + those of about.

    The distinct pairs of names are resolved first (name_pairs), so that the register itself is read once more and
    joined to them: by a broadcast where they were counted to be few, else by the planner's choice. about, keyed by
    prop_id, is joined to the pairs, so rows of properties it lacks go with the join. Rows whose names are null or
    stand for nothing are left out.
    """
    pairs = name_pairs(register, properties)
    if about is not None:
        pairs = pairs.join(about, "prop_id")
    pairs = broadcast_if_small(cut(pairs.withColumnsRenamed({"property_name": "__en", "property_name_rus": "__ru"})), MANY_PAIRS)
    extra = [c for c in pairs.columns if not c.startswith("__")]
    rows = register.select(*(F.col(c) for c in keep), F.col("property_name").alias("__n1"), F.col("property_name_rus").alias("__n2"))
    return rows.join(pairs, F.col("__n1").eqNullSafe(F.col("__en")) & F.col("__n2").eqNullSafe(F.col("__ru"))).select(*(rows[c] for c in keep), *(pairs[c] for c in extra))


def registry(tags: DataFrame) -> DataFrame:
    """(tag_key, tag_number): every tag of the registry once, without a byte order mark; blank and null lines don't count."""
    t = tags.select(F.trim(F.regexp_replace("tag", "^﻿", "")).alias("tag_number")).filter(F.length("tag_number") > 0)
    return t.groupBy(tag_key(F.col("tag_number")).alias("tag_key")).agg(F.min("tag_number").alias("tag_number"))
