"""Attribute rows into one wide, typed row per entity (problem 3)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.quantity import cell
from tagloom.functions.text import tag_key
from tagloom.operators.resolve import registry, with_property
from tagloom.session import shuffle_width

QUANTITY = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("unit", T.StringType())])
MAX_COLUMNS = 5_000
FIELD = "\u001f"  # between the numbers of a row, which goes to Python as one text


def _quantity(s: str) -> tuple:
    low, high, unit = s.split("|", 2)
    return float(low), float(high) if high else None, unit or None


ENCODERS = {"quantity": (QUANTITY, _quantity), "date": (T.DateType(), datetime.date.fromisoformat), "flag": (T.BooleanType(), lambda s: s == "true")}
TEXT = (T.StringType(), str)


def newest(a: tuple, b: tuple) -> tuple:
    """The later of two (rank, text) cells; associative and commutative, so any order of merging gives the same."""
    return a if a[0] >= b[0] else b


def _start(value: tuple) -> dict:
    return {value[0]: value[1]}


def _add(slots: dict, value: tuple) -> dict:
    k, c = value
    slots[k] = newest(slots[k], c) if k in slots else c
    return slots


def _merge(a: dict, b: dict) -> dict:
    for value in b.items():
        _add(a, value)
    return a


def columns_of(properties: DataFrame) -> list[tuple[int, str, str]]:
    """(prop_id, column name, kind) of each property in order of prop_id; names are unique whatever the dictionary holds."""
    rows = properties.select("prop_id", "prop_name_eng", "value_kind").filter("prop_id is not null").dropDuplicates(["prop_id"]).orderBy("prop_id").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} properties make no wide table")
    return [(r[0], f"p{r[0]:03d}_" + re.sub(r"\W+", "_", (r[1] or "").lower()).strip("_"), r[2] or "text") for r in rows]


def typed_cells(register: DataFrame, properties: DataFrame) -> DataFrame:
    """(tag_key, prop_id, rank, text): the register's rows with a tag, a property and a value that reads as the property's kind."""
    kinds = properties.select("prop_id", F.coalesce("value_kind", F.lit("text")).alias("kind")).groupBy("prop_id").agg(F.min("kind").alias("kind"))
    reg = register.select("row_id", "tag_number", "property_name", "property_name_rus", "property_value", "entered_at")
    rows = with_property(reg, properties, ["row_id", "tag_number", "property_value", "entered_at"], kinds)
    at = F.coalesce(F.unix_micros(F.col("entered_at").cast("timestamp")), F.lit(-(2**62)))
    both = F.struct(tag_key(F.col("tag_number")).alias("tag_key"), cell(F.col("property_value"), F.col("kind")).alias("text"))
    read = rows.select("prop_id", at.alias("at"), F.coalesce("row_id", F.lit(-1)).alias("row"), F.explode(F.array(both)).alias("r"))
    return read.filter("r.text is not null and r.tag_key != ''").select("r.tag_key", "prop_id", "at", "row", "r.text")


def wide_table(spark: SparkSession, register: DataFrame, properties: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per tag of the registry with one typed column per property.

    The cells are merged with combineByKey on slot registers ({property: newest cell}) before they are shuffled, so a
    hot tag costs one register a task, however many rows it has. Of several readable values the one entered last
    wins, ties by row_id. Null tags, unknown names and unreadable values fill no cell; a registry tag without any
    cell comes out with nulls; empty inputs give an empty table. Extra columns are ignored.
    """
    columns = columns_of(properties)
    slots = {p: (i, ENCODERS.get(k, TEXT)[1]) for i, (p, _, k) in enumerate(columns)}
    schema = T.StructType([T.StructField("tag_key", T.StringType()), *(T.StructField(c, ENCODERS.get(k, TEXT)[0]) for _, c, k in columns)])

    def encode(part: Iterator) -> Iterator[tuple]:
        for key, register_ in part:
            row = [None] * len(slots)
            for p, (_, text) in register_.items():
                i, encoder = slots[p]
                row[i] = encoder(text)
            yield (key, *row)

    def unpacked(part: Iterator) -> Iterator[tuple]:
        for (packed,) in part:
            n, prop, at, row, both = packed.split(FIELD, 4)
            yield both[: int(n)], (int(prop), ((int(at), int(row)), both[int(n) :]))

    numbers = (c.cast("string") for c in (F.length("tag_key"), F.col("prop_id"), F.col("at"), F.col("row")))
    packed = typed_cells(register, properties).select(F.concat_ws(FIELD, *numbers, F.concat("tag_key", "text")))
    merged = packed.rdd.mapPartitions(unpacked, True).combineByKey(_start, _add, _merge, shuffle_width(spark))
    wide = spark.createDataFrame(merged.mapPartitions(encode), schema, verifySchema=False)
    return registry(tags).join(wide, "tag_key", "left").drop("tag_key")


def filled(wide: DataFrame, properties: DataFrame) -> DataFrame:
    """(tag_number, prop_id) of every filled cell of the wide table."""
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.lit(p).cast("long")) for p, c, _ in columns_of(properties)])
    return wide.select("tag_number", F.explode(F.array_compact(cells)).alias("prop_id"))
