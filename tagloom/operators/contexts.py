"""Contexts for the extractor: sections of technical data, tables as text, frames of snippets and tables, chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import let
from tagloom.operators.slicing import NEXT_TABLE_WITHIN, next_within, no_contents, sections

# --- fixed values ---------------------------------------------------------------------------------
TECHNICAL = [
    "технические характеристики", "техническая характеристика", "основные характеристики", "технические данные",
    "technical characteristics", "technical parameters", "technical specification", "technical data",
]
LEAST_SECTION, MOST_SECTION = 1024, 15_000
CHUNK = 100_000
SNIPPETS, TABLES, TABLE = "Отрывки:", "Таблицы:", "Таблица:"
NEXT_HEADING = r"\n\d+(\.\d+)*\.?\s+[A-ZА-Я]{2,}"
# --------------------------------------------------------------------------------------------------


def technical_sections(heads: DataFrame, tables: DataFrame) -> DataFrame:
    """(file_id, start, end): the first section of each file whose heading names technical data.

    A section counts if it is LEAST_SECTION characters long or a table follows within NEXT_TABLE_WITHIN of its start,
    and isn't longer than MOST_SECTION. Headings of a table of contents don't count.
    """
    low = F.lower("heading")
    named = F.lit(False)
    for s in TECHNICAL:
        named = named | low.contains(s)
    found = sections(no_contents(heads)).filter(named)
    near = found.join(tables, (found["file_id"] == tables["file_id"]) & (tables["index"] >= found["start"]) & (tables["index"] < found["start"] + NEXT_TABLE_WITHIN), "left_semi").select("file_id", "start").withColumn("near", F.lit(True))
    ok = found.join(near.distinct(), ["file_id", "start"], "left").filter((F.col("end") - F.col("start") >= LEAST_SECTION) | F.col("near"))
    return ok.groupBy("file_id").agg(F.min(F.struct("start", "end")).alias("s")).select("file_id", "s.start", "s.end").filter(F.col("end") - F.col("start") <= MOST_SECTION)


def text_section(text: Column) -> Column:
    """struct<start, end> of a technical section that only the text shows: from the last place of the first of the TECHNICAL names that stands in it to the next numbered heading in capitals; null without either.

    Earlier places are taken for entries of a table of contents. This is our reading of what the text route means.
    """
    low = F.lower(text)
    last = lambda s: F.when(low.contains(s), F.length(low) - F.instr(F.reverse(low), F.lit(s[::-1])) - F.lit(len(s)) + 1)
    start = F.coalesce(*map(last, TECHNICAL))
    after = F.regexp_instr(F.substr(text, start + 1, F.length(text)), F.lit(NEXT_HEADING))
    return F.when(after > 0, F.struct(start.cast("long").alias("start"), (start + after).cast("long").alias("end")))


def technical_texts(files: DataFrame, heads: DataFrame, tables: DataFrame) -> DataFrame:
    """(file_id, start, end, text): the section of technical data of each file: by its headings, else by its text; none longer than MOST_SECTION.

    A section of fewer than LEAST_SECTION characters gets the next table within NEXT_TABLE_WITHIN of its start put
    behind it, as a text. tables has file_id, table_idx, index and cells.
    """
    by_head = technical_sections(heads, tables).select("file_id", F.struct("start", "end").alias("h"))
    at = F.coalesce("h", text_section(F.col("pure_text")))
    rows = files.select("file_id", "pure_text").join(by_head, "file_id", "left").withColumn("s", F.explode(F.array(at))).filter(F.col("s.end") - F.col("s.start") <= MOST_SECTION)
    found = rows.select("file_id", "s.start", "s.end", F.substr("pure_text", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")).alias("text"))
    short = found.filter(F.col("end") - F.col("start") < LEAST_SECTION).select("file_id", F.col("start").alias("target"))
    near = next_within(short, tables.select("file_id", "table_idx", "index")).join(tables.select("file_id", "table_idx", cells_text(F.col("cells")).alias("table")), ["file_id", "table_idx"]).select("file_id", "table")
    return found.join(near, "file_id", "left").select("file_id", "start", "end", F.concat("text", F.coalesce(F.concat(F.lit("\n\n" + TABLE), "table"), F.lit(""))).alias("text"))


def cells_text(cells: Column, form: str = "html") -> Column:
    """table_text of a table's cells in one array of (row_idx, col_idx, col_label, value)."""
    ordered = F.array_sort(F.transform(cells, lambda c: F.named_struct(F.lit("r"), c["row_idx"], F.lit("c"), c["col_idx"], F.lit("v"), _shown(c["value"]))))
    row = lambda o, r: F.transform(F.filter(o, lambda c: c["r"] == r), lambda c: c["v"])
    rows = let(ordered, lambda o: F.array_distinct(F.transform(F.array_distinct(F.transform(o, lambda c: c["r"])), lambda r: row(o, r))))
    return _whole(F.transform(rows, lambda r: _line(r, form)), form)


def _shown(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, "\\n", " "), F.lit("-"))


def _line(row: Column, form: str) -> Column:
    if form == "json":
        return F.to_json(row)
    if form == "markdown":
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    return F.concat(F.lit("<tr><td>"), F.array_join(row, "</td><td>"), F.lit("</td></tr>"))


def _whole(lines: Column, form: str) -> Column:
    if form == "json":
        return F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    return F.array_join(lines, "\n") if form == "markdown" else F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))


def table_text(cells: DataFrame, form: str = "html") -> DataFrame:
    """(table_id, text): a table's rows in order, repeated rows once, as html, markdown or json; nulls as -, line ends as spaces."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", _shown(F.col("value")).alias("v")))), lambda c: c["v"])
    rows = cells.groupBy("table_id", "row_idx").agg(row.alias("r")).groupBy("table_id", "r").agg(F.min("row_idx").alias("row_idx"))
    joined = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", _line(F.col("r"), form).alias("l")))), lambda x: x["l"]).alias("x"))
    return joined.select("table_id", _whole(F.col("x"), form).alias("text"))


def frames(snippets: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """(key, context): the snippets of each key under a headline, then its tables under another; snippets and tables have key, ord and text."""
    part = lambda d, name: d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias(name))
    both = part(snippets, "s").join(part(tables, "t"), key, "full_outer")
    head = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(title), F.lit("\n"), F.col(c)))
    return both.select(key, F.concat_ws("\n", head(SNIPPETS, "s"), head(TABLES, "t")).alias("context"))


def cut_chunks(text: str, size: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a text: each ends at the last newline within size characters, else the last space, else after size; newlines and spaces between parts, and white space behind them, belong to none."""
    if len(text) < size:
        return [(0, len(text))]
    out, i = [], 0
    while i < len(text):
        if text[i] in "\n ":
            m = re.compile(r"\S").search(text, i)
            if not m:
                break
            i = m.start()
        end = text.rfind("\n", i, i + size)
        if end < 0:
            end = text.rfind(" ", i, i + size)
        if end < 0:
            end = min(i + size, len(text))
        out.append((i, end - i))
        i = end
    return out


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk_no, start, chars) of cut_chunks, for models that take no more than size characters; null and empty texts give no row."""

    @F.pandas_udf("array<struct<start:long,chars:long>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "chars": n} for a, n in cut_chunks(t, size)])

    cut = df.filter(F.length(text) > 0).select(key, F.posexplode(run(F.col(text))).alias("chunk_no", "c"))
    return cut.select(key, "chunk_no", "c.start", "c.chars")
