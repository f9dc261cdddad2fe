"""Quantities in different units into numbers in one common unit (problem 2)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.forest import Forest, isotonic
from tagloom.functions.quantity import UNITS, base_milli, quantity, unit_key, unit_table
from tagloom.functions.text import is_missing
from tagloom.operators.resolve import with_property
from tagloom.session import cut

SCHEMA = ["row_id", "value_no", "base_milli", "item_id", "unit_from", "confidence"]


def measured(spark: SparkSession, register: DataFrame, properties: DataFrame, validations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Register rows of properties whose unit has a list and whose value reads as a number or range, with their unit if one is written.

    Columns: row_id, prop_id, list_name, low, high, item_id, factor, before (null without a known unit), unit_from
    (uom, value, none or unknown), and the fields that the classifier looks at. The value is read in a generator over
    one array, which the optimizer neither doubles in a filter nor works out again.
    """
    lists = validations.filter("target_col = 'uom'").groupBy("prop_id").agg(F.min("list_name").alias("list_name"))
    units = F.broadcast(unit_table(spark, allowed))  # fixed spellings
    keep = ["row_id", "tag_number", "property_value", "uom", "property_description_rus"]
    rows = with_property(register.select(*keep, "property_name", "property_name_rus"), properties, keep, lists)
    rows = rows.withColumn("q", F.explode(F.array(quantity(F.col("property_value"))))).filter("q.low is not null")
    rows = rows.withColumn("no_uom", is_missing(F.col("uom")))
    rows = rows.withColumn("written", F.explode(F.array(F.when(F.col("no_uom"), F.col("q.unit")).otherwise(F.col("uom")))))
    rows = rows.withColumn("unit_key", unit_key(F.col("written"))).join(units, ["list_name", "unit_key"], "left")
    source = (
        F.when(F.col("item_id").isNotNull(), F.when(F.col("no_uom"), F.lit("value")).otherwise(F.lit("uom")))
        .when(F.col("no_uom") & (F.col("written") == ""), F.lit("none"))
        .otherwise(F.lit("unknown"))
    )
    return rows.select("row_id", "prop_id", "list_name", F.col("q.low").alias("low"), F.col("q.high").alias("high"), "item_id", "factor", "before", source.alias("unit_from"), "tag_number", "property_value", "uom", "property_description_rus")


FIELDS = ["list_name", "prop_id", "low", "high", "property_value", "tag_number", "property_description_rus"]
MOST_UNITS = max(map(len, UNITS.values()))


class Features:
    """What the classifier looks at, worked out alike for the sample and for the rows to predict.

    Magnitude: for each unit of the row's list, how far the value read in it lies from the middle of its property's
    known values, in powers of ten, over the spread of these. Category: the property, as the shares its units have;
    list and tag class. Source: the plant area that the tag names, and the note beside the value. Neighbouring fields:
    form of the number (sign, decimals, exponent, range). Vocabularies and middles come from the sample it was fitted on.
    """

    def __init__(self, sample: pd.DataFrame, factors: dict[str, list[tuple[int, float, float]]]):
        self.factors = factors
        self.lists = {k: i for i, k in enumerate(sorted(factors))}
        tag = sample.tag_number.map(_tag_parts)
        self.areas = {k: i for i, k in enumerate(sorted({t[0] for t in tag}))}
        self.classes = {k: i for i, k in enumerate(sorted({t[1] for t in tag}))}
        self.notes = {k: i for i, k in enumerate(sorted(sample.property_description_rus.dropna().unique()))}
        place = {item: (k, i) for k, us in factors.items() for i, (item, _, _) in enumerate(us)}
        at = sample.item_id.map(lambda x: place.get(x, ("", 0))[1]).to_numpy(int)
        base = self._bases(sample)[np.arange(len(sample)), at]
        known = pd.DataFrame({"prop": sample.prop_id.to_numpy(), "at": at, "base": base})
        by = known.groupby("prop").base
        self.middle = by.median().to_dict()
        self.spread = (by.quantile(0.8) - by.quantile(0.2)).clip(lower=0.2).to_dict()
        self.share = {k: np.bincount(v, minlength=MOST_UNITS)[:MOST_UNITS] + 0.5 for k, v in known.groupby("prop")["at"]}

    def _bases(self, rows: pd.DataFrame) -> np.ndarray:
        """log10 of the size of each row's value in the common unit, read in each unit of its list."""
        out = np.full((len(rows), MOST_UNITS), np.nan)
        low, lists = rows.low.to_numpy(float), rows.list_name.to_numpy()
        for name, us in self.factors.items():
            m = lists == name
            for k, (_, factor, before) in enumerate(us):
                out[m, k] = np.log10(np.abs((low[m] + before) * factor) + 1e-9)
        return out

    def table(self, rows: pd.DataFrame) -> np.ndarray:
        props = rows.prop_id.tolist()
        middle = np.array([self.middle.get(x, np.nan) for x in props])
        spread = np.array([self.spread.get(x, 1.0) for x in props])
        far = np.abs(self._bases(rows) - middle[:, None]) / spread[:, None]
        even = np.full(MOST_UNITS, 0.5)
        share = np.array([self.share.get(x, even) for x in props]).reshape(-1, MOST_UNITS)
        share = share / share.sum(1, keepdims=True)
        tag = [_tag_parts(t) for t in rows.tag_number]
        text = rows.property_value.fillna("")
        decimals = text.str.extract(r"[.,](\d+)", expand=False).fillna("").str.len()
        low = rows.low.to_numpy(float)
        other = [
            [self.lists.get(x, -1) for x in rows.list_name], [self.areas.get(t[0], -1) for t in tag], [self.classes.get(t[1], -1) for t in tag], [self.notes.get(x, -1) for x in rows.property_description_rus],
            np.log10(np.abs(low) + 1e-6), np.sign(low), decimals, text.str.contains("[0-9][eE]", regex=True), rows.high.notna(), np.nan_to_num(far, nan=99.0).argmin(1) if len(rows) else [],
        ]
        return np.column_stack([np.nan_to_num(far, nan=99.0), share, *(np.asarray(x, float) for x in other)])


def _tag_parts(tag: str | None) -> tuple[str, str]:
    """(plant area, class) of a tag: its first run of digits and its first group of letters only."""
    parts = re.split(r"[\s\-–—_]+", (tag or "").upper())
    return next((p for p in parts if p.isdigit()), ""), next((p for p in parts if p.isalpha() and len(p) > 1), "")


class UnitClassifier:
    """A random forest over Features, with calibrated confidence.

    Fitted on the max_rows rows with a written unit that have the smallest hash of row_id (a bounded sample; four
    fifths grow the trees, one fifth calibrates). A unit is only chosen from the row's own list.
    """

    def __init__(self, rows: DataFrame, factors: dict[str, list[tuple[int, float, float]]], max_rows: int = 20_000, bins: int = 20):
        self.ready = False
        labelled = rows.filter(F.col("item_id").isNotNull()).select("row_id", "item_id", *FIELDS).withColumn("h", F.xxhash64("row_id")).orderBy("h", "row_id").limit(max_rows)
        pdf = labelled.toPandas()
        if pdf.item_id.nunique() < 2 or len(pdf) < 50:
            return
        held = pdf.h.to_numpy() % 5 == 0
        self.features = Features(pdf[~held], factors)
        self.items = np.array(sorted(pdf.item_id.unique()), int)
        self.own = {k: np.searchsorted(self.items, np.sort(v)) for k, v in pdf.groupby("list_name").item_id.unique().items()}
        label = np.searchsorted(self.items, pdf.item_id.to_numpy(int))
        x = self.features.table(pdf)
        self.forest = Forest(trees=24, depth=12).fit(x[~held], label[~held], len(self.items))
        self.bins, self.share, self.ready = bins, np.linspace(0, 1, bins), True
        guess, raw = self.guess(x[held], pdf.list_name[held])
        bin_ = np.minimum((raw * bins).astype(int), bins - 1)
        self.share = np.array(isotonic(np.bincount(bin_, guess == label[held], bins), np.bincount(bin_, minlength=bins)))

    def guess(self, x: np.ndarray, lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(the likeliest unit of each row's list as its place among the items, or -1; its share of the list's chances)."""
        p = self.forest.predict(x)
        best, raw = np.full(len(x), -1), np.zeros(len(x))
        for name, own in self.own.items():
            m = (lists == name).to_numpy()
            q = p[m][:, own]
            best[m] = own[q.argmax(1)] if m.any() else -1
            raw[m] = q.max(1) / np.maximum(q.sum(1), 1e-9) if m.any() else 0
        return best, raw

    def judge(self, rows: pd.DataFrame) -> pd.DataFrame:
        """item_id (null where nothing can be said) and confidence of each row."""
        best, raw = self.guess(self.features.table(rows), rows.list_name)
        sure = self.share[np.minimum((raw * self.bins).astype(int), self.bins - 1)]
        item = pd.array(np.where(best < 0, 0, self.items[best]), "Int32")
        item[best < 0] = pd.NA
        return pd.DataFrame({"item_id": item, "confidence": np.where(best < 0, 0.0, sure)})

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with item_id and confidence, for rows without a written unit; a generator keeps the optimizer from judging a row twice."""
        if not self.ready:
            return rows.withColumn("item_id", F.lit(None).cast("int")).withColumn("confidence", F.lit(0.0))
        model = self

        @F.pandas_udf("struct<item_id:int,confidence:double>")
        def run(f: pd.DataFrame) -> pd.DataFrame:
            return model.judge(f)

        return rows.withColumn("r", F.explode(F.array(run(F.struct(*FIELDS))))).withColumn("item_id", F.col("r.item_id")).withColumn("confidence", F.col("r.confidence")).drop("r")


def _by_end(rows: DataFrame, *columns: str) -> DataFrame:
    """(row_id, value_no, base_milli, columns): a row for the number or the lower end, another for the upper end of a range."""
    ends = F.array(F.struct(F.lit(1).alias("value_no"), F.col("low").alias("v")), F.struct(F.lit(2).alias("value_no"), F.col("high").alias("v")))
    each = rows.withColumn("e", F.explode(ends)).filter("e.v is not null")
    return each.select("row_id", "e.value_no", base_milli(F.col("e.v"), F.col("factor"), F.col("before")).alias("base_milli"), *columns)


def common_units(spark: SparkSession, register: DataFrame, properties: DataFrame, validations: DataFrame, allowed: DataFrame, confident: float = 0.9, max_rows: int = 20_000) -> DataFrame:
    """(row_id, value_no, base_milli, item_id, unit_from, confidence, review): every readable quantity in its common unit.

    value_no is 1 for the number or the lower end of a range, 2 for the upper end; base_milli the value in the common
    unit times 1000. unit_from: uom or value where the unit is written (confidence 1), predicted where it is missing
    and the classifier gave one, unknown where something is written that is no unit of the list, none where nothing
    is. Rows whose unit stays unknown or whose confidence is under confident have review set; without any unit
    base_milli is null. Repeated rows come out each; null values and names give no row. The rows read are cut from
    their lineage, as the sample, the written and the missing units are taken from them.
    """
    rows = cut(measured(spark, register, properties, validations, allowed))
    table = unit_table(spark, allowed).groupBy("list_name", "item_id").agg(F.first("factor").alias("factor"), F.first("before").alias("before"))
    known = sorted(map(tuple, table.collect()))  # a row a unit of UNITS
    factors = {k: [r[1:] for r in known if r[0] == k] for k in {r[0] for r in known}}
    classifier = UnitClassifier(rows, factors, max_rows)
    keep = ["row_id", "low", "high", "item_id", "factor", "before", "unit_from", "confidence"]
    written = rows.filter("unit_from != 'none'").withColumn("confidence", F.when(F.col("item_id").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
    bare = rows.filter("unit_from = 'none'").drop("item_id", "factor", "before")
    guessed = classifier.predict(bare).join(F.broadcast(table.drop("list_name").dropDuplicates(["item_id"])), "item_id", "left").withColumn("unit_from", F.when(F.col("item_id").isNotNull(), F.lit("predicted")).otherwise(F.lit("none")))
    return _by_end(written.select(*keep).unionByName(guessed.select(*keep)), "item_id", "unit_from", "confidence").withColumn("review", F.col("confidence") < confident)


def converted(all_rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """(row_id, value_no, base_milli) of the rows with a written unit other than the common one; distinct as far as row_id is."""
    common = [next(iter(u)) for u in UNITS.values()]
    base = F.broadcast(allowed.filter(F.col("list_name").isin(list(UNITS)) & F.col("item").isin(common)).select("item_id").distinct())  # at most one a list of UNITS
    return all_rows.filter("unit_from in ('uom', 'value') and base_milli is not null").join(base, "item_id", "left_anti").select("row_id", "value_no", "base_milli")
