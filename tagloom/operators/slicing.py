"""Pages, sections and the parts of a document that concern one tag."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.search import is_tag, tags_in

# --- fixed values ---------------------------------------------------------------------------------
PAGE_MARK = r"\[!@#\$%\]EOP[0-9]+\[!@#\$%\]"
PAGE_END = "[!@#$%]EOP{}[!@#$%]"
SLICE_MARK = "(!@#$)EOF;{};{};(!@#$)"
LEAST_SLICE = 120
NEXT_TABLE_WITHIN = 1024
CONTENTS_END = "....."
HEADING = r"^(\d+(?:\.\d+)*)\.?\s+(.+)$"
TITLE = r"^(\d+\.*)+\s+([A-ZА-Я]{2,})"
# --------------------------------------------------------------------------------------------------


def page_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, start, chars): the pages of a text that end with page marks; start counts from 0, page by the order of the marks."""
    cut = df.select(key, F.posexplode(F.split(text, PAGE_MARK, -1)).alias("page", "body"), F.regexp_extract_all(F.col(text), F.lit(f"({PAGE_MARK})"), F.lit(1)).alias("marks"))
    w = Window.partitionBy(key).orderBy("page")
    size = F.length("body") + F.coalesce(F.length(F.get("marks", F.col("page"))), F.lit(0))
    spans = cut.withColumn("size", size).withColumn("start", F.sum("size").over(w) - F.col("size"))
    return spans.filter((F.length("body") > 0) | (F.col("page") < F.size("marks"))).select(key, "page", F.col("start").cast("long").alias("start"), F.length("body").alias("chars"))


def page_of(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, pos, page): the page on which each hit stands. The join keeps the equality on key, so it is no cross join."""
    on = (hits[key] == spans[key]) & (hits["pos"] >= spans["start"]) & (hits["pos"] < spans["start"] + spans["chars"])
    return hits.join(spans, on).select(hits[key], hits["pos"], spans["page"])


def snippets(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, page, snippet): the pages of each text that hold the needle, without regard to case, each once.

    A hit that goes over a page's end counts for the page on which it begins, so pages are looked at with the
    beginning of what follows. Texts are cut within their row and never shuffled.
    """
    n = needle.lower()
    body = F.posexplode(F.split(F.col(text), PAGE_MARK, -1)).alias("page", "snippet")
    pages = df.filter(F.lower(text).contains(n)).select(key, body) if n else df.select(key, body).limit(0)
    return pages.filter(F.lower("snippet").contains(n))


def headings(files: DataFrame) -> DataFrame:
    """(file_id, ord, pos, heading) of the headers' JSON; null and unreadable ones give no row."""
    parsed = F.from_json("headers", "array<array<string>>")
    return files.select("file_id", F.posexplode(parsed).alias("ord", "h")).select("file_id", "ord", F.get("h", F.lit(0)).cast("long").alias("pos"), F.get("h", F.lit(1)).alias("heading"))


def numbered(heading: Column) -> Column:
    """struct<number, title> of a numbered heading, both empty where it has no number."""
    return F.struct(F.regexp_extract(heading, HEADING, 1).alias("number"), F.regexp_extract(heading, HEADING, 2).alias("title"))


def bold_headings(spans: DataFrame) -> DataFrame:
    """(file_id, page, block, heading): numbered lines of a text layer that have a bold piece; spans has file_id, page, block, ord, text and is_bold.

    The pieces of a block are put together in order, white space squeezed. Null pieces count as empty.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    lines = spans.groupBy("file_id", "page", "block").agg(F.max(F.coalesce("is_bold", F.lit(False))).alias("bold"), F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("heading"))
    return lines.filter(F.col("bold") & F.col("heading").rlike(HEADING)).select("file_id", "page", "block", "heading")


def no_contents(heads: DataFrame) -> DataFrame:
    """Headings without those of a table of contents, which end in dots, or in dots and three more characters."""
    h = F.col("heading")
    return heads.filter(~(h.endswith(CONTENTS_END) | F.substring(h, F.lit(1), F.length(h) - 3).endswith(CONTENTS_END)))


def sections(heads: DataFrame) -> DataFrame:
    """(file_id, ord, heading, start, end): a section goes to the next heading; the last heading starts none."""
    w = Window.partitionBy("file_id").orderBy("pos", "ord")
    return heads.withColumn("end", F.lead("pos").over(w)).filter("end is not null").select("file_id", "ord", "heading", F.col("pos").alias("start"), "end")


def next_within(targets: DataFrame, tables: DataFrame, within: int = NEXT_TABLE_WITHIN) -> DataFrame:
    """(file_id, target, table_idx, distance): the nearest table that follows each target within less than within characters, ties by the first."""
    on = (targets["file_id"] == tables["file_id"]) & (tables["index"] >= targets["target"]) & (tables["index"] < targets["target"] + within)
    pairs = targets.join(tables, on).select(targets["file_id"], "target", "table_idx", (F.col("index") - F.col("target")).alias("distance"))
    best = pairs.groupBy("file_id", "target").agg(F.min(F.struct("distance", "table_idx")).alias("b"))
    return best.select("file_id", "target", "b.table_idx", "b.distance")


def nearest(targets: DataFrame, tables: DataFrame) -> DataFrame:
    """(file_id, target, table_idx): the table nearest to each target on either side, ties by the first."""
    pairs = targets.join(tables, "file_id").select("file_id", "target", "table_idx", F.abs(F.col("index") - F.col("target")).alias("distance"))  # tables of one file
    return pairs.groupBy("file_id", "target").agg(F.min(F.struct("distance", "table_idx")).alias("b")).select("file_id", "target", "b.table_idx")


def tables_of_slices(slices: DataFrame, tables: DataFrame) -> DataFrame:
    """(file_id, tag, table_idx): the tables that concern a tag: those that name it, and those whose place lies in one of its slices.

    slices has file_id, tag, start, end; tables file_id, table_idx, index and tags. Both joins are equi-joins.
    """
    t = tables.select("file_id", "table_idx", "index", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    named = t.select("file_id", F.explode("tags").alias("tag"), "table_idx").join(slices.select("file_id", "tag").distinct(), ["file_id", "tag"])
    inside = slices.join(t.drop("tags"), "file_id").filter("index >= start and index <= end").select("file_id", "tag", "table_idx")
    return named.select("file_id", "tag", "table_idx").unionByName(inside).distinct()


def headings_of_slices(slices: DataFrame, heads: DataFrame) -> DataFrame:
    """(file_id, tag, ord, pos, heading): headings within the slices of a tag, their place counted from the beginning of the first slice that holds them."""
    on = (slices["file_id"] == heads["file_id"]) & (heads["pos"] >= slices["start"]) & (heads["pos"] <= slices["end"])
    found = slices.withColumnRenamed("ord", "slice").join(heads, on).groupBy(slices["file_id"], "tag", heads["ord"]).agg(F.min_by(F.struct((F.col("pos") - F.col("start")).alias("pos"), "heading"), "slice").alias("h"))
    return found.select("file_id", "tag", "ord", "h.pos", "h.heading")


def tag_places(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, pos): every valid tag of every text with its place counted from 0, found in one pass."""
    pattern = r"((?:[A-Z0-9]+-)+(?:[A-Z0-9]+))"
    between = F.split(text, pattern, -1)
    rows = df.select(key, F.arrays_zip(between.alias("gap"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("tag")).alias("z"))
    flat = rows.select(key, F.posexplode("z").alias("i", "p")).select(key, "i", F.length("p.gap").alias("gap"), F.col("p.tag").alias("tag"))
    w = Window.partitionBy(key).orderBy("i")
    at = F.sum(F.col("gap") + F.coalesce(F.length("tag"), F.lit(0))).over(w) - F.coalesce(F.length("tag"), F.lit(0))
    placed = flat.withColumn("pos", at).filter("tag is not null")
    prefix = F.col("tag").rlike("^E-[0-9]")
    return placed.select(key, F.when(prefix, F.expr("substring(tag, 3)")).otherwise(F.col("tag")).alias("tag"), (F.col("pos") + F.when(prefix, 2).otherwise(0)).cast("long").alias("pos")).filter(is_tag(F.col("tag")))


def next_other(places: DataFrame, key: str) -> DataFrame:
    """(key, tag, pos, end): for each place of a tag the place of the next other tag, null if none follows.

    Tags that differ in their last character only count as the same. A window over the places in reverse carries, for
    each place, the first place of the run of equal stems behind it.
    """
    stem = F.expr("substring(tag, 1, greatest(length(tag) - 1, 1))")
    w = Window.partitionBy(key).orderBy("pos")
    runs = places.withColumn("stem", stem).withColumn("new", (F.lag("stem").over(w) != F.col("stem")).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    starts = runs.groupBy(key, "run").agg(F.min("pos").alias("start")).withColumn("run", F.col("run") - 1)
    return runs.join(starts, [key, "run"], "left").select(key, "tag", "pos", F.col("start").alias("end"))


def cut_slices(places: list[tuple[int, int | None]], length: int) -> list[tuple[int, int]]:
    """Slices of one tag from (place, end) pairs in order.

    One that begins in an earlier slice starts where that one ends, and is left out if it ends there too; so is one
    of LEAST_SLICE characters or fewer. The first open one that is kept ends the list.
    """
    out: list[tuple[int, int]] = []
    for start, end in places:
        stop = length if end is None else end
        over = next((b for a, b in out if a <= start <= b), None)
        if (over is not None and stop <= over) or stop - start <= LEAST_SLICE:
            continue
        out.append((start if over is None else over, stop))
        if end is None:
            break
    return out


def tag_slices(texts: DataFrame, key: str, text: str, registry: DataFrame | None = None) -> DataFrame:
    """(key, tag, ord, start, end): the parts of each text that concern each of its tags; with registry (tag), only its tags count.

    The rule which slices are kept goes by order, so it runs once per text and tag over its places; groups hold the
    places of one tag in one text only. The text's length goes with its places, so texts aren't shuffled.
    """
    places = tag_places(texts, key, text)
    if registry is not None:
        places = places.join(registry.select("tag").distinct(), "tag", "left_semi")
    spans = next_other(places, key).join(texts.select(key, F.length(text).alias("length")), key)

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def cut(places: pd.Series, length: pd.Series) -> pd.Series:
        rows = ([(int(p["pos"]), None if p["end"] is None or pd.isna(p["end"]) else int(p["end"])) for p in ps] for ps in places)
        return pd.Series([[{"start": a, "end": b} for a, b in cut_slices(sorted(r, key=lambda x: x[0]), int(n))] for r, n in zip(rows, length, strict=True)])

    gathered = spans.groupBy(key, "tag").agg(F.collect_list(F.struct("pos", "end")).alias("places"), F.first("length").alias("length"))
    return gathered.select(key, "tag", F.posexplode(cut("places", "length")).alias("ord", "s")).select(key, "tag", "ord", "s.start", "s.end")


def slice_texts(texts: DataFrame, slices: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, text): what a text says of each tag: its slices in order, each with its end mark, joined by newlines.

    The slices of a text are gathered to one small array and joined to its row, so every text is read once.
    """
    parts = slices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tag", "ord", "start", "end"))).alias("parts"))
    part = lambda s: F.concat(F.substr(F.col("__t"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.format_string(SLICE_MARK.replace("{}", "%s"), s["start"].cast("string"), s["end"].cast("string")))
    rows = texts.select(key, F.col(text).alias("__t")).join(parts, key)
    each = rows.select(key, "__t", "parts", F.explode(F.array_distinct(F.transform("parts", lambda s: s["tag"]))).alias("tag"))
    return each.select(key, "tag", F.array_join(F.transform(F.filter("parts", lambda s: s["tag"] == F.col("tag")), part), "\n").alias("text"))


def anchored(files: DataFrame) -> DataFrame:
    """(file_id, ord, page, pos, heading): where each heading stands on its page; files has file_id, pure_text and heads, an array of (page, text).

    Looked for between the end marks of the page before and of its own page: the title of a numbered heading in
    capitals, else the whole heading; failing that its number, else its first five characters; failing that it is
    dropped. Works within the file's row.
    """
    t = F.col("pure_text")
    mark = lambda p: F.format_string(PAGE_END.replace("%", "%%").replace("{}", "%d"), p)
    each = files.select("file_id", "pure_text", F.posexplode("heads").alias("ord", "h")).select("file_id", "pure_text", "ord", F.col("h.page").alias("page"), F.col("h.text").alias("heading"))
    low = F.greatest(F.position(mark(F.col("page") - 1), t), F.lit(1))
    end = F.position(mark(F.col("page")), t)
    page = F.substr(t, low, F.when(end == 0, F.length(t)).otherwise(F.greatest(end - low, F.lit(0))))
    title, number = F.regexp_extract("heading", TITLE, 2), F.regexp_extract("heading", TITLE, 1)
    first = F.position(F.when(title != "", title).otherwise(F.col("heading")), F.col("body"))
    second = F.position(F.when(title != "", number).otherwise(F.substr("heading", F.lit(1), F.lit(5))), F.col("body"))
    placed = each.withColumn("low", low).withColumn("body", page).select("file_id", "ord", "page", "heading", "low", F.when(first > 0, first).otherwise(second).alias("at"))
    return placed.filter("at > 0").select("file_id", "ord", "page", (F.col("low") + F.col("at") - 2).cast("long").alias("pos"), "heading")


def put_tables(text: str, anchors: list[dict]) -> tuple[str, list[int]]:
    """The text with the tags of its tables put in, and each table's place behind them; anchors in order of their pages."""
    indexes = []
    for a in anchors:
        before, page = a["before"], int(a["page"])
        start = max(0, text.find(PAGE_END.format(page - 1)))
        at = text.find(before, start) if before else -1
        if at >= 0:
            at += len(before)
        else:
            at = 0
            for k in range(page - 1, -1, -1):
                mark = PAGE_END.format(k)
                found = text.find(mark)
                if found >= 0:
                    at = found + len(mark)
                    break
        put = ";".join(a["passport_tags"] if a["passport_tags"] is not None else []) + ";".join(a["tags"] if a["tags"] is not None else [])
        text = text[:at] + put + text[at:]
        indexes.append(at + len(put))
    return text, indexes


def insert_tables(files: DataFrame) -> DataFrame:
    """(file_id, text, indexes): the tags of tables put back into the text, by page, behind the text that stood before each table.

    files has file_id, text and anchors, an array of (page, table_idx, before, passport_tags, tags). The text before a
    table is looked for from its page on; without it the table stands behind the nearest earlier page's end mark,
    else at the beginning. indexes has the tables' places in order of (page, table_idx). Each insertion moves the later ones, so it runs file by file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *put_tables(text or "", list(anchors if anchors is not None else []))) for k, text, anchors in zip(b["file_id"], b["text"], b["anchors"], strict=True)]
            yield pd.DataFrame(rows, columns=["file_id", "text", "indexes"])

    return files.select("file_id", "text", F.array_sort("anchors").alias("anchors")).mapInPandas(run, "file_id long, text string, indexes array<int>")


def assembled(pages: DataFrame) -> DataFrame:
    """(file_id, text): a file's pages in order, each with its end mark, runs of newlines and of spaces squeezed; null pages count as empty."""
    page = F.concat(F.coalesce("text", F.lit("")), F.format_string(PAGE_END.replace("%", "%%").replace("{}", "%d"), F.col("page")))
    whole = pages.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return whole.select("file_id", F.regexp_replace(F.regexp_replace("text", "\n+", "\n"), " +", " ").alias("text"))


def tags_by_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag): the different valid tags of each text."""
    return df.select(key, F.explode(F.array_distinct(tags_in(F.col(text)))).alias("tag")).filter(is_tag(F.col("tag")))
