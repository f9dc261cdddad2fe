"""What concerns a tag in a file, and the ways to find contexts for a register's tasks in it, from the surest to the weakest."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import cascade, contexts, search, slicing

# --- fixed values ---------------------------------------------------------------------------------
PASSPORT_WORDS = ["vendor", "contractor", "location", "подрядчик", "поставщик", "заказчик"]
PASSPORT = "паспорт"
MARKS = re.compile(r"\[!@#\$%\]EOP[0-9]+\[!@#\$%\]|\(!@#\$\)EOF;[0-9]+;[0-9]+;\(!@#\$\)")
# --------------------------------------------------------------------------------------------------


@dataclass
class Material:
    """What concerns each tag in each file.

    slices (file_id, tag, ord, start, end), texts (file_id, tag, text), tables (file_id, tag, table_idx, cells),
    passports (file_id, tag, table_idx, cells), headings (file_id, tag, ord, pos, heading), sections (file_id, tag, text).
    """

    slices: DataFrame
    texts: DataFrame
    tables: DataFrame
    passports: DataFrame
    headings: DataFrame
    sections: DataFrame


def passport_tables(tables: DataFrame, words: list[str] = PASSPORT_WORDS) -> DataFrame:
    """tables (file_id, table_idx, index, cells) of which more than one of the words stands in the cells, without regard to case."""
    text = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c["value"], F.lit(""))), " "))
    n = sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))
    return tables.filter(n > 1)


def passport_tags(tables: DataFrame, registry: DataFrame) -> DataFrame:
    """(file_id, table_idx, tag): registry tags (tag) that stand in the text of tables which name a passport.

    Every stretch of a table's text between white space that is as long as a tag is looked up by an equi-join, so
    tables and tags are never crossed.
    """
    text = F.array_join(F.transform(F.filter("cells", lambda c: c["value"].isNotNull()), lambda c: c["value"]), " ")
    rows = tables.select("file_id", "table_idx", text.alias("t")).filter(F.lower("t").contains(PASSPORT))
    return contained(rows, ["file_id", "table_idx"], "t", registry)


def _stretches(n: int) -> Column:
    """Every stretch of n characters of __p."""
    at = F.when(F.length("__p") >= n, F.sequence(F.lit(1), F.length("__p") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(F.col("__p"), i, F.lit(n)))


def contained(df: DataFrame, keys: list[str], text: str, registry: DataFrame) -> DataFrame:
    """(keys, tag): which registry tags (tag) stand anywhere in each text, by an equi-join over its stretches.

    A stretch begins at each place of the text; for each length that tags have one is cut. The lengths are few, as
    tags are short; tags with white space in them are looked up over the whole text, others within its words.
    """
    tags = registry.select("tag").filter("length(tag) > 0").distinct()
    sizes = tags.select(F.length("tag").alias("n"), F.col("tag").rlike(r"\s").alias("spaced")).distinct().collect()  # lengths of tags
    found = None
    for spaced in sorted({r["spaced"] for r in sizes}):
        lengths = sorted(r["n"] for r in sizes if r["spaced"] == spaced)
        piece = df.select(*keys, F.col(text).alias("__p")) if spaced else df.select(*keys, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("__p"))
        piece = piece.filter(F.length("__p") >= lengths[0])
        cut = F.flatten(F.array(*map(_stretches, lengths)))
        own = piece.select(*keys, F.explode(F.array_distinct(cut)).alias("tag")).join(tags.filter(F.col("tag").rlike(r"\s") == F.lit(spaced)), "tag").select(*keys, "tag")
        found = own if found is None else found.unionByName(own)
    return found.distinct() if found is not None else df.select(*keys, F.lit(None).cast("string").alias("tag")).limit(0)


def preload(files: DataFrame, heads: DataFrame, tables: DataFrame, registry: DataFrame, tasks: DataFrame) -> Material:
    """What concerns the tags of tasks (file_id, tag) in files (file_id, pure_text).

    heads has file_id, ord, pos, heading; tables file_id, table_idx, index, tags and cells; registry tag. A tag that
    isn't found as it is gets searched once more with its look-alike letters mended. The passport table is the
    nearest to the tag's first slice, or to the beginning, of those that are one.
    """
    wanted = tasks.select("file_id", "tag").distinct()
    slices = slicing.tag_slices(files, "file_id", "pure_text", registry).join(wanted, ["file_id", "tag"], "left_semi")
    mended = wanted.join(slices.select("file_id", "tag").distinct(), ["file_id", "tag"], "left_anti").withColumn("__needle", search.mend_looks(F.col("tag"))).filter("__needle != tag")
    slices = slices.unionByName(_literal_slices(files, mended))
    texts = slicing.slice_texts(files, slices, "file_id", "pure_text")
    cells = tables.select("file_id", "table_idx", "cells")
    own = slicing.tables_of_slices(slices, tables).join(cells, ["file_id", "table_idx"])
    headings = slicing.headings_of_slices(slices, heads)
    first = wanted.join(slices.groupBy("file_id", "tag").agg(F.min("start").alias("first")), ["file_id", "tag"], "left").select("file_id", "tag", F.coalesce("first", F.lit(0)).alias("target"))
    near = slicing.nearest(first.select("file_id", "target").distinct(), passport_tables(tables).select("file_id", "table_idx", "index"))
    passports = first.join(near, ["file_id", "target"]).join(cells, ["file_id", "table_idx"]).select("file_id", "tag", "table_idx", "cells")
    sections = contexts.technical_texts(files, heads, tables).join(wanted, "file_id").select("file_id", "tag", "text")
    return Material(slices, texts, own, passports, headings, sections)


def _literal_slices(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(file_id, tag, ord, start, end): from each place of a mended tag to the end of the text, the first such part only, as no tag of the registry ends it."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def cut(text: pd.Series, needle: pd.Series) -> pd.Series:
        at = (t.lower().find(n.lower()) if t and n else -1 for t, n in zip(text, needle, strict=True))
        return pd.Series([[{"start": a, "end": b} for a, b in slicing.cut_slices([(i, None)], len(t or ""))] if i >= 0 else [] for i, t in zip(at, text, strict=True)])

    found = files.select("file_id", "pure_text").join(needles, "file_id")
    return found.select("file_id", "tag", F.posexplode(cut("pure_text", "__needle")).alias("ord", "s")).select("file_id", "tag", "ord", "s.start", "s.end")


Strategy = Callable[[DataFrame, Material], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a way to find contexts: from tasks (row_id, file_id, tag, name_en, name_ru) and the material to (row_id, context, name, ord).

    Its confidence is that of cascade.CONFIDENCE, or of extra where the caller of solve_register gives one.
    """

    def add(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return add


def page_frames(text: str, hits: list[int]) -> str:
    """The pages of a text, or parts between the marks of slices, on which the hits stand, each once in order."""
    bounds = [0, *(m.end() for m in MARKS.finditer(text))]
    ends = [*(m.start() for m in MARKS.finditer(text)), len(text)]
    out = [text[a:b] for a, b in zip(bounds, ends, strict=True) if any(a <= h < b for h in hits)]
    return "\n".join(out)


def _asked(tasks: DataFrame, which: str) -> DataFrame:
    """(file_id, tag, asks): the names, with their tasks, that are looked for in what concerns a tag in a file; as many as a tag has properties and keywords."""
    return tasks.filter(F.length(which) > 0).groupBy("file_id", "tag").agg(F.collect_list(F.struct("row_id", F.col(which).alias("name"))).alias("asks"))


Find = Callable[[str, str, dict[str, list[int]]], list[int]]
FOUND = "array<struct<row_id:long,name:string,context:string>>"


def _in_text(which: str, find: Find) -> Strategy:
    def contexts_of(tasks: DataFrame, material: Material) -> DataFrame:
        @F.pandas_udf(FOUND)
        def frame(texts: pd.Series, asks: pd.Series) -> pd.Series:
            out = []
            for text, asked in zip(texts, asks, strict=True):
                places = search.token_places(text or "")
                hits = ((a["row_id"], a["name"], find(text, a["name"], places)) for a in asked)
                out.append([{"row_id": k, "name": n, "context": f"{contexts.SNIPPETS}\n{page_frames(text, h)}"} for k, n, h in hits if 0 < len(h) < search.HIT_LIMIT])
            return pd.Series(out)

        rows = material.texts.join(_asked(tasks, which), ["file_id", "tag"])
        return rows.select(F.col("file_id").alias("ord"), F.explode(frame("text", "asks")).alias("f")).select("f.row_id", "f.name", "ord", "f.context")

    return contexts_of


def _in_tables(which: str) -> Strategy:
    def contexts_of(tasks: DataFrame, material: Material) -> DataFrame:
        @F.pandas_udf("array<struct<row_id:long,name:string,hits:int>>")
        def found(tables: pd.Series, asks: pd.Series) -> pd.Series:
            as_rows = lambda t: [(c["row_idx"], c["col_idx"], c["col_label"], c["value"]) for c in t] if t is not None else []
            hits = ([*zip(asked, search.cells_with(as_rows(t), *(a["name"] for a in asked)), strict=True)] for t, asked in zip(tables, asks, strict=True))
            return pd.Series([[{"row_id": a["row_id"], "name": a["name"], "hits": len(p)} for a, p in own if p] for own in hits])

        rows = material.tables.join(_asked(tasks, which), ["file_id", "tag"]).select("file_id", "table_idx", contexts.cells_text(F.col("cells")).alias("t"), F.explode(found("cells", "asks")).alias("f"))
        by = rows.groupBy("f.row_id", "f.name", F.col("file_id").alias("ord")).agg(F.sum("f.hits").alias("hits"), F.array_sort(F.collect_list(F.struct("table_idx", "t"))).alias("x"))
        framed = F.concat(F.lit(contexts.TABLES + "\n"), F.array_join(F.transform("x", lambda t: t["t"]), "\n"))
        return by.filter(F.col("hits") < search.HIT_LIMIT).select("row_id", "name", "ord", framed.alias("context"))

    return contexts_of


def _phrase_hits(text: str, name: str, places: dict[str, list[int]]) -> list[int]:
    return search.phrase_hits(text, name, places=places)


def _subset_hits(text: str, name: str, places: dict[str, list[int]]) -> list[int]:
    found = search.most_specific(text, name, places=places)
    return found[1] if found else []


strategy("table_en")(_in_tables("name_en"))
strategy("table_ru")(_in_tables("name_ru"))
strategy("simple_en")(_in_text("name_en", _phrase_hits))
strategy("simple_ru")(_in_text("name_ru", _phrase_hits))
strategy("tokens_en")(_in_text("name_en", _subset_hits))
strategy("tokens_ru")(_in_text("name_ru", _subset_hits))


@strategy("tech_specs")
def technical(tasks: DataFrame, material: Material) -> DataFrame:
    """The whole section of technical data."""
    return tasks.join(material.sections, ["file_id", "tag"]).select("row_id", F.coalesce(F.nullif("name_ru", F.lit("")), "name_en").alias("name"), F.col("file_id").alias("ord"), F.col("text").alias("context"))


def header_search(tasks: DataFrame, material: Material) -> DataFrame:
    """(row_id, context, name, ord): the passport table of tasks whose property is searched in the header, if the Russian, else the English name is found in it."""
    rows = tasks.filter("condition = 'search_in_header'").join(material.passports, ["file_id", "tag"])
    for which in ("name_ru", "name_en"):
        rows = search.table_search(rows, "cells", which).withColumnRenamed("points", f"__{which}")
    name = F.when(F.size("__name_ru") > 0, F.col("name_ru")).when(F.size("__name_en") > 0, F.col("name_en"))
    return rows.select("row_id", name.alias("name"), F.col("file_id").alias("ord"), contexts.cells_text(F.col("cells")).alias("context")).filter("name is not null")


def tiers(tasks: DataFrame, material: Material, keywords: DataFrame | None = None, chosen: list[str] | None = None) -> list[tuple[str, float, DataFrame]]:
    """What cascade.solve takes: the header first where a property asks for it, then every strategy by confidence, then the same with each alternative keyword in its order, the technical section last.

    keywords has row_id, keyword_no, keyword; a keyword with Cyrillic letters takes the place of the Russian name,
    others that of the English one. chosen names the strategies to run, all by default.
    """
    names = chosen if chosen is not None else list(STRATEGIES)
    out = []
    if "condition" in tasks.columns:
        out.append(("header", 1.0, header_search(tasks, material).withColumn("stage", F.lit(0))))
    for name in names:
        found = STRATEGIES[name](tasks, material)
        out.append((name, cascade.CONFIDENCE[name], found.withColumn("stage", F.lit(1_000_000 if name == "tech_specs" else 1))))
    if keywords is not None:
        other = tasks.select("row_id", "file_id", "tag").join(keywords, "row_id")
        russian = search.has_cyrillic(F.col("keyword"))
        other = other.withColumn("name_ru", F.when(russian, F.col("keyword")).otherwise(F.lit(""))).withColumn("name_en", F.when(russian, F.lit("")).otherwise(F.col("keyword")))
        numbered = other.select("row_id", F.col("keyword").alias("name"), "keyword_no").groupBy("row_id", "name").agg(F.min("keyword_no").alias("keyword_no"))
        for name in names:
            if name != "tech_specs":
                found = STRATEGIES[name](other, material).join(numbered, ["row_id", "name"])
                out.append((name, cascade.CONFIDENCE[name], found.withColumn("stage", F.col("keyword_no") + 2).drop("keyword_no")))
    return out


def solve_register(tasks: DataFrame, material: Material, extractor: cascade.Extractor, keywords: DataFrame | None = None, chosen: list[str] | None = None) -> DataFrame:
    """cascade.attempts of the tasks over every tier; rows with valid set are the answers.

    tasks has row_id, file_id, tag, name_en, name_ru, condition, values, units, hint, possible and kind; a task that
    stands in several files has a row for each, whose other columns are the same.
    """
    asked = tasks.groupBy("row_id").agg(
        F.first(F.coalesce(F.nullif("name_en", F.lit("")), "name_ru")).alias("name"), *(F.first(c).alias(c) for c in ("values", "units", "hint", "possible", "kind")), F.max(F.coalesce(F.col("condition") == "only_if_mentioned", F.lit(False))).alias("mentioned")
    )
    return cascade.attempts(asked, tiers(tasks, material, keywords, chosen), extractor)


