"""Queries of the document search and register filling operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import tag_key
from tagloom.operators import boxes, cascade, contexts, search, slicing, store, strategies, tagfix
from tagloom.operators.resolve import registry, with_property
from tagloom.session import cut, table
from tagloom.sources import files as sources
from tagloom.sources import schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TAG = r"(?:E-)?((?:[A-Z0-9]+-)+(?:[A-Z0-9]+))"
VALID = "regexp_matches(tag, '[A-Z]') AND regexp_matches(tag, '[0-9]') AND NOT contains(tag, 'AGCC') AND NOT contains(tag, 'agcc')"

# ---- tags and words --------------------------------------------------------------------------------


@query(f"SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TAG}', 1)) AS tag FROM documents) GROUP BY doc_id, tag")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(search.tags_in(F.col("text"))).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TAG}', 1)) AS tag FROM documents) WHERE {VALID}")
def tag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.tags_by_text(table(spark, sf_dir, "documents"), "doc_id", "text")


HEADS = "SELECT file_id, i - 1 AS ord, CAST(json_extract_string(h, '$[0]') AS BIGINT) AS pos, json_extract_string(h, '$[1]') AS heading FROM (SELECT file_id, unnest(CAST(json_extract(headers, '$[*]') AS JSON[])) AS h, generate_subscripts(CAST(json_extract(headers, '$[*]') AS JSON[]), 1) AS i FROM files WHERE headers IS NOT NULL)"
TABLE_CELLS = "SELECT file_id, table_idx, index, i - 1 AS row_idx, 0 AS col_idx, 'line' AS col_label, piece AS value FROM (SELECT file_id, ord AS table_idx, pos AS index, unnest(string_split(body, chr(10))) AS piece, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM (SELECT h.file_id, h.ord, h.pos, substr(f.pure_text, CAST(h.pos AS INTEGER) + 1, 200) AS body FROM ({HEADS}) h JOIN files f USING (file_id)))"


def _table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one column from the 200 characters behind every heading, as the test data has none: (file_id, table_idx, index, row_idx, col_idx, col_label, value)."""
    f = table(spark, sf_dir, "files")
    pick = F.transform(F.from_json("headers", "array<array<string>>"), lambda h, i: F.struct(i.alias("ord"), F.get(h, F.lit(0)).cast("int").alias("pos")))
    body = F.split(F.substr(F.col("pure_text"), F.col("h.pos") + 1, F.lit(200)), "\n")
    rows = f.select("file_id", "pure_text", F.explode(pick).alias("h")).select("file_id", F.col("h.ord").alias("table_idx"), F.col("h.pos").cast("long").alias("index"), F.posexplode(body).alias("row_idx", "value"))
    return rows.select("file_id", "table_idx", "index", F.col("row_idx").cast("long").alias("row_idx"), F.lit(0).cast("long").alias("col_idx"), F.lit("line").alias("col_label"), "value")


@query(f"SELECT file_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT file_id, tag FROM (SELECT file_id, unnest(regexp_extract_all(pure_text, '{TAG}', 1)) AS tag FROM files UNION ALL SELECT file_id, unnest(regexp_extract_all(value, '{TAG}', 1)) FROM ({TABLE_CELLS.replace('{HEADS}', HEADS)})) WHERE {VALID}) GROUP BY file_id")
def mentioned_tags_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = slicing.tags_by_text(table(spark, sf_dir, "files"), "file_id", "pure_text").unionByName(slicing.tags_by_text(_table_cells(spark, sf_dir), "file_id", "value"))
    return t.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


HITS = "SELECT file_id, CAST(sum(length(piece) + {n}) OVER (PARTITION BY file_id ORDER BY i) - {n} AS BIGINT) AS pos, i, n FROM (SELECT file_id, unnest(string_split(lower(pure_text), '{needle}')) AS piece, generate_subscripts(string_split(lower(pure_text), '{needle}'), 1) AS i, len(string_split(lower(pure_text), '{needle}')) AS n FROM files WHERE pure_text IS NOT NULL)"


def _hits(needle: str) -> str:
    return f"SELECT file_id, pos FROM ({HITS.format(n=len(needle), needle=needle)}) WHERE i < n"


@query(_hits("pressure"))
def literal_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal_hits(table(spark, sf_dir, "files"), "file_id", "pure_text", "pressure").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) BETWEEN 1 AND 49 AS searched FROM documents WHERE text IS NOT NULL")
def occurrence_counts_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hit_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "the")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS cleaned FROM documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("cleaned"))


@query(r"SELECT file_id, regexp_replace(regexp_replace(string_agg(text || '[!@#$%]EOP' || page || '[!@#$%]', chr(10) ORDER BY page), '\n+', chr(10), 'g'), ' +', ' ', 'g') AS text FROM (SELECT file_id, i - 1 AS page, body AS text FROM (SELECT file_id, unnest(string_split_regex(pure_text, '\[!@#\$%\]EOP[0-9]+\[!@#\$%\]')) AS body, generate_subscripts(string_split_regex(pure_text, '\[!@#\$%\]EOP[0-9]+\[!@#\$%\]'), 1) AS i FROM files)) GROUP BY file_id")
def pages_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("file_id", F.posexplode(F.split("pure_text", slicing.PAGE_MARK, -1)).alias("page", "text"))
    return slicing.assembled(f)


@query("SELECT row_id, regexp_replace(trim(tag_number, ' '), '^E-', '') AS tag, regexp_replace(replace(property_name, '.', '-'), '\\([^()]*\\)', '', 'g') AS name_eng, regexp_replace(replace(property_name_rus, '.', '-'), '\\([^()]*\\)', '', 'g') AS name_rus FROM register WHERE trim(tag_number, ' ') <> ''")
def register_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prepared(table(spark, sf_dir, "register"))


@query("SELECT row_id, regexp_matches(lower(property_value), '[а-яё]') AS cyrillic, regexp_matches(lower(property_value), '[a-zа-яё]') AS letters FROM register")
def script_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("property_value")
    return table(spark, sf_dir, "register").select("row_id", search.has_cyrillic(v).alias("cyrillic"), search.has_letters(v).alias("letters"))


STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) WHERE word NOT IN ({STOP}) GROUP BY word")
def valid_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(search.words_of(F.col("text"))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    "SELECT row_id, array_to_string(list_transform(list_filter(string_split_regex(property_value, '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: CASE WHEN (length(regexp_replace(lower(w), '[^а-яё]', '', 'g')) > 0 AND length(regexp_replace(lower(w), '[^a-z]', '', 'g')) > 0 AND length(regexp_replace(lower(w), '[^а-яё]', '', 'g')) >= length(regexp_replace(lower(w), '[^a-z]', '', 'g'))) OR (length(regexp_replace(lower(w), '[^a-z]', '', 'g')) > 3 AND regexp_full_match(lower(w), '[aceopxybkmht0-9-]+')) THEN translate(w, 'aceopxyABEKMHOPCTX', 'асеорхуАВЕКМНОРСТХ') ELSE w END), ' ') AS fixed FROM register WHERE property_value IS NOT NULL"
)
def homoglyph_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "register").filter("property_value is not null").select("row_id", search.mend_looks(F.col("property_value")).alias("fixed"))


@query()
def tag_fuzzy_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagfix.candidates(table(spark, sf_dir, "files"), "file_id", "pure_text")
    return tagfix.corrected(spark, found, registry(table(spark, sf_dir, "tags")))


# ---- registry, register and properties --------------------------------------------------------------

KEYED = "regexp_replace(upper(regexp_replace({c}, '[ \\t\\n\\r]+', '', 'g')), '^E-', '')"


@query("SELECT DISTINCT trim(ltrim(tag, chr(65279)), ' ') AS tag FROM tags WHERE trim(ltrim(tag, chr(65279)), ' ') <> ''")
def tag_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(table(spark, sf_dir, "tags")).select(F.col("tag_number").alias("tag"))


TAGS_OF_FILES = f"SELECT DISTINCT file_id, unnest(regexp_extract_all(mentioned_tags, '{TAG}', 1)) AS tag FROM files"


@query(f"SELECT r.tag_number AS tag, min(f.file_id) AS first_file, count(DISTINCT f.file_id) AS files FROM (SELECT DISTINCT tag_number FROM register) r JOIN ({TAGS_OF_FILES}) f ON f.tag = r.tag_number GROUP BY 1")
def tag_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("file_id", F.explode(F.array_distinct(search.tags_in(F.col("mentioned_tags")))).alias("tag"))
    r = table(spark, sf_dir, "register").select(F.col("tag_number").alias("tag")).distinct()
    return f.join(r, "tag").groupBy("tag").agg(F.min("file_id").alias("first_file"), F.countDistinct("file_id").alias("files"))


@query("SELECT t.tag, min(f.file_id) AS file_id FROM (SELECT DISTINCT trim(ltrim(tag, chr(65279)), ' ') AS tag FROM tags) t JOIN files f ON contains(f.mentioned_tags, t.tag) WHERE t.tag <> '' GROUP BY t.tag")
def tag_lookup_substring_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of a mention that is as long as a tag is looked up by an equi-join, so files and tags are never crossed."""
    f = table(spark, sf_dir, "files").select("file_id", "mentioned_tags").filter("mentioned_tags is not null")
    return strategies.contained(f, ["file_id"], "mentioned_tags", tag_registry(spark, sf_dir)).groupBy("tag").agg(F.min("file_id").alias("file_id"))


@query(f"SELECT DISTINCT {KEYED.format(c='tag_number')} AS tag FROM register WHERE tag_number IS NOT NULL AND {KEYED.format(c='tag_number')} NOT IN ({TAGS_OF_FILES.replace('DISTINCT file_id, ', '')} WHERE mentioned_tags IS NOT NULL)")
def tag_missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.upper(F.regexp_replace("tag_number", "[ \\t\\n\\r]+", "")), "^E-", "")
    f = table(spark, sf_dir, "files").select(F.explode(search.tags_in(F.col("mentioned_tags"))).alias("tag"))
    return table(spark, sf_dir, "register").filter("tag_number is not null").select(key.alias("tag")).distinct().join(f, "tag", "left_anti")


@query("SELECT r.row_id, p.prop_id, coalesce(nullif(p.prop_desc_eng, 'none'), r.property_description_rus) AS description, coalesce(p.search_condition, 'none') AS condition FROM register r LEFT JOIN properties p ON p.prop_name_eng = r.property_name")
def property_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "properties").select("prop_id", F.col("prop_name_eng").alias("property_name"), "prop_desc_eng", "search_condition")
    r = table(spark, sf_dir, "register").select("row_id", "property_name", "property_description_rus").join(p, "property_name", "left")
    return r.select("row_id", "prop_id", F.coalesce(F.nullif("prop_desc_eng", F.lit("none")), "property_description_rus").alias("description"), F.coalesce("search_condition", F.lit("none")).alias("condition"))


@query("SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def property_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_wins(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


@query("SELECT prop_id, CASE WHEN prop_name_eng IN ('rated power', 'design pressure') THEN 'search_in_header' WHEN prop_name_eng IN ('design pressure', 'dry mass') THEN 'only_if_mentioned' ELSE 'none' END AS search_condition, coalesce(CASE prop_name_eng WHEN 'rated power' THEN 'power;' WHEN 'dry mass' THEN 'weight;' END, 'none') AS alt_keywords, CAST(prop_name_eng IN ('dry mass', 'wall thickness') AS INTEGER) AS flag, CASE prop_name_eng WHEN 'wall thickness' THEN 'least value' ELSE '' END AS desc_for_llm FROM properties")
def property_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda *rows, more="": spark.createDataFrame([*rows], f"name string{more}")
    p = table(spark, sf_dir, "properties").select("prop_id", "prop_name_eng")
    found = store.enriched(
        p, one(("rated power",), ("design pressure",)), one(("design pressure",), ("dry mass",)), one(("rated power", "power;"), ("dry mass", "weight;"), more=", alt_keywords string"), one(("dry mass",), ("wall thickness",)), one(("wall thickness", "least value"), more=", desc_for_llm string")
    )
    return found.drop("prop_name_eng")


@query("SELECT external_id, prop_name_eng, prop_name_rus, CASE WHEN prop_desc_eng IS NOT NULL AND prop_desc_rus IS NOT NULL THEN prop_desc_eng ELSE 'none' END AS prop_desc_eng, CASE WHEN prop_desc_eng IS NOT NULL AND prop_desc_rus IS NOT NULL THEN prop_desc_rus ELSE 'none' END AS prop_desc_rus FROM properties WHERE length(prop_name_eng) > 0 AND length(prop_name_rus) > 0 AND contains(external_id, '-') AND NOT contains(external_id, '.ru') AND NOT contains(external_id, '.org')")
def property_dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "properties")
    as_json = F.to_json(F.struct(F.col("external_id").alias("id"), F.struct(F.col("prop_name_eng").alias("EN"), F.col("prop_name_rus").alias("RU")).alias("names"), F.struct(F.col("prop_desc_eng").alias("EN"), F.col("prop_desc_rus").alias("RU")).alias("comments")))
    return store.dump_rows(p.select(F.from_json(as_json, sources.DUMP).alias("d")).select("d.*"))


@query("SELECT v.prop_id, v.target_col, string_agg(a.item, '|' ORDER BY a.item_id) AS items FROM validations v JOIN allowed_items a USING (list_name) GROUP BY v.prop_id, v.target_col, v.list_name")
def validation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.allowed_lists(table(spark, sf_dir, "validations"), table(spark, sf_dir, "allowed_items"))


@query("SELECT prop_id, array_to_string(list_filter(list_transform(string_split(alt_keywords, ';'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS keywords FROM properties WHERE alt_keywords IS NOT NULL AND alt_keywords <> 'none'")
def alt_keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "properties").select("prop_id", F.array_join(store.keyword_list(F.col("alt_keywords")), "|").alias("keywords")).filter("keywords is not null")


@query("SELECT prop_id, k AS keyword, CASE WHEN regexp_matches(lower(k), '[а-яё]') THEN 'ru' ELSE 'en' END AS route FROM (SELECT prop_id, unnest(list_filter(list_transform(string_split(alt_keywords, ';'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS k FROM properties WHERE alt_keywords <> 'none')")
def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "properties").select("prop_id", F.explode(store.keyword_list(F.col("alt_keywords"))).alias("keyword"))
    return p.withColumn("route", F.when(search.has_cyrillic(F.col("keyword")), "ru").otherwise("en"))


TASK_RUN = 10_000


@query("SELECT tag_number AS tag, count(*) AS tasks, min(row_id) AS first_row, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows FROM register WHERE tag_number IS NOT NULL GROUP BY tag_number")
def tasks_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag with all its rows; those of a hot tag are put in order in runs of TASK_RUN row ids, which are then only joined, so no sort holds its list."""
    r = table(spark, sf_dir, "register").filter("tag_number is not null").select("tag_number", "row_id")
    run = F.floor(F.col("row_id") / TASK_RUN).alias("run")
    runs = r.groupBy("tag_number", run).agg(F.count("*").alias("n"), F.min("row_id").alias("least"), F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("ids"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"]), ",")
    return runs.groupBy(F.col("tag_number").alias("tag")).agg(F.sum("n").alias("tasks"), F.min("least").alias("first_row"), whole.alias("rows"))


UPSERT_NEW = "SELECT file_name, pages, mentioned_tags FROM files WHERE file_id % 3 = 0 UNION ALL SELECT 'new_' || file_name, pages + 1, mentioned_tags FROM files WHERE file_id % 5 = 0"


def _upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "files")
    new = f.filter("file_id % 3 = 0").select("file_name", "pages", "mentioned_tags").unionByName(f.filter("file_id % 5 = 0").select(F.concat(F.lit("new_"), "file_name").alias("file_name"), (F.col("pages") + 1).alias("pages"), "mentioned_tags"))
    return f.select("file_id", "file_name", (F.col("pages") * 10).alias("pages"), F.lit("old").alias("mentioned_tags")), new


@query(f"SELECT coalesce(o.file_id, (SELECT max(file_id) FROM files) + row_number() OVER (PARTITION BY o.file_id IS NULL ORDER BY n.file_name)) AS file_id, coalesce(o.file_name, n.file_name) AS file_name, CASE WHEN n.file_name IS NULL THEN o.pages * 10 ELSE n.pages END AS pages, CASE WHEN n.file_name IS NULL THEN 'old' ELSE n.mentioned_tags END AS mentioned_tags FROM files o FULL JOIN ({UPSERT_NEW}) n ON o.file_name = n.file_name")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _upsert(spark, sf_dir)
    return store.upsert(old, new, "file_name", "file_id", ["pages", "mentioned_tags"])


@query(f"SELECT count(*) FILTER (WHERE o.file_name IS NULL) AS added, count(*) FILTER (WHERE o.file_name IS NOT NULL) AS updated FROM ({UPSERT_NEW}) n LEFT JOIN files o USING (file_name)")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_counts(*_upsert(spark, sf_dir), "file_name")


# ---- words and boxes --------------------------------------------------------------------------------

WORDS = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, value, ((i - 1) % 10) * 100 AS x1, ((i - 1) // 10) * 30 AS y1, ((i - 1) % 10) * 100 + 90 AS x2, ((i - 1) // 10) * 30 + 20 AS y2 FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS value, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL)"
BOXES = "SELECT doc_id, k AS box_id, (doc_id * 37 + k * 211) % 700 AS bx1, (doc_id * 53 + k * 97) % 400 AS by1, (doc_id * 37 + k * 211) % 700 + 150 + k * 60 AS bx2, (doc_id * 53 + k * 97) % 400 + 120 AS by2 FROM documents, range(3) t(k)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("ord", "value"))
    x, y = (F.col("ord") % 10) * 100, F.floor(F.col("ord") / 10) * 30
    return w.select("doc_id", F.col("ord").cast("long").alias("ord"), "value", x.cast("long").alias("x1"), y.alias("y1"), (x + 90).cast("long").alias("x2"), (y + 20).alias("y2"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("box_id"))
    x, y = (F.col("doc_id") * 37 + F.col("box_id") * 211) % 700, (F.col("doc_id") * 53 + F.col("box_id") * 97) % 400
    return d.select("doc_id", "box_id", x.alias("bx1"), y.alias("by1"), (x + 150 + F.col("box_id") * 60).alias("bx2"), (y + 120).alias("by2"))


@query(f"SELECT doc_id, string_agg(value, ' ' ORDER BY ord) AS text FROM ({WORDS}) WHERE x1 >= 100 AND x2 <= 500 AND y1 >= 30 AND y2 <= 200 GROUP BY doc_id")
def words_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.words_in(_words(spark, sf_dir), (100, 30, 500, 200), ["doc_id"])


@query(f"SELECT doc_id, ord, value FROM ({WORDS}) w WHERE NOT EXISTS (SELECT 1 FROM ({BOXES}) b WHERE b.doc_id = w.doc_id AND (w.x1 + w.x2) / 2.0 BETWEEN bx1 AND bx2 AND (w.y1 + w.y2) / 2.0 BETWEEN by1 AND by2)")
def words_excluding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.words_outside(_words(spark, sf_dir), _boxes(spark, sf_dir), ["doc_id"]).select("doc_id", "ord", "value")


@query(f"SELECT w.doc_id, w.ord, b.box_id, w.x1 - b.bx1 AS x1, w.y1 - b.by1 AS y1, w.x2 - b.bx1 AS x2, w.y2 - b.by1 AS y2 FROM ({WORDS}) w JOIN ({BOXES}) b ON b.doc_id = w.doc_id AND (w.x1 + w.x2) / 2.0 BETWEEN bx1 AND bx2 AND (w.y1 + w.y2) / 2.0 BETWEEN by1 AND by2")
def words_slice_reorigin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.words_in_boxes(_words(spark, sf_dir), _boxes(spark, sf_dir), ["doc_id"])


NESTED = "SELECT doc_id, k AS box_id, doc_id * 13 % 60 + (k % 4) * 17 + doc_id * k % 11 AS x1, doc_id * 7 % 60 + (k % 4) * 17 + doc_id * k % 5 AS y1, doc_id * 13 % 60 + 400 - (k % 4) * 17 - (k // 4) * (doc_id % 90) AS x2, doc_id * 7 % 60 + 300 - (k % 4) * 17 - (k // 4) * (doc_id % 70) AS y2, k % 4 AS depth FROM documents, range(8) t(k)"
IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(8)])).alias("box_id"))
    k, i = F.col("box_id"), F.col("doc_id")
    depth, half = k % 4, F.floor(k / 4)
    x, y = i * 13 % 60, i * 7 % 60
    return d.select("doc_id", "box_id", (x + depth * 17 + i * k % 11).alias("x1"), (y + depth * 17 + i * k % 5).alias("y1"), (x + 400 - depth * 17 - half * (i % 90)).alias("x2"), (y + 300 - depth * 17 - half * (i % 70)).alias("y2"), depth.alias("depth"))


@query(f"WITH b AS ({NESTED}) SELECT a.doc_id, a.box_id AS box_a, b.box_id AS box_b, round(CAST({IOU} AS DOUBLE) / ({AREA.format('a')} + {AREA.format('b')} - {IOU}), 6) AS iou FROM b a JOIN b ON a.doc_id = b.doc_id AND a.box_id < b.box_id WHERE {IOU} > 0")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.overlaps(_nested(spark, sf_dir), ["doc_id"])


# A box nearly is one that is kept (shared over joint area above 0.9), or is what a drill-down leaves of it: deeper, every side moved in by 17 pixels a level, within 8.
TWIN = "({k}.x2 > {b}.x1 AND {b}.x2 > {k}.x1 AND {k}.y2 > {b}.y1 AND {b}.y2 > {k}.y1 AND (least({k}.x2, {b}.x2) - greatest({k}.x1, {b}.x1)) * (least({k}.y2, {b}.y2) - greatest({k}.y1, {b}.y1)) > 0.9 * (({k}.x2 - {k}.x1) * ({k}.y2 - {k}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({k}.x2, {b}.x2) - greatest({k}.x1, {b}.x1)) * (least({k}.y2, {b}.y2) - greatest({k}.y1, {b}.y1))))"
SHADE = "({b}.depth > {k}.depth AND abs({k}.x1 + 17 * ({b}.depth - {k}.depth) - {b}.x1) <= 8 AND abs({k}.y1 + 17 * ({b}.depth - {k}.depth) - {b}.y1) <= 8 AND abs({k}.x2 - 17 * ({b}.depth - {k}.depth) - {b}.x2) <= 8 AND abs({k}.y2 - 17 * ({b}.depth - {k}.depth) - {b}.y2) <= 8)"
KEPT = f"o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth, box_id) AS n FROM ({NESTED})), g AS (SELECT doc_id, 1 AS n, [struct_pack(box_id := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, depth := depth)] AS kept FROM o WHERE n = 1 UNION ALL SELECT g.doc_id, o.n, CASE WHEN len(list_filter(g.kept, lambda k: {TWIN.format(k='k', b='o')} OR {SHADE.format(k='k', b='o')})) > 0 THEN g.kept ELSE list_append(g.kept, struct_pack(box_id := o.box_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, depth := o.depth)) END FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1), u AS (SELECT doc_id, unnest(kept, recursive := true) FROM g WHERE n = 8)"


@query(f"WITH RECURSIVE {KEPT} SELECT doc_id, box_id FROM u")
def box_dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.dedupe(_nested(spark, sf_dir), ["doc_id"])


@query(f"WITH RECURSIVE {KEPT} SELECT doc_id, box_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.doc_id = a.doc_id AND b.box_id <> a.box_id AND b.x1 >= a.x1 - 17 AND b.y1 >= a.y1 - 17 AND b.x2 <= a.x2 + 17 AND b.y2 <= a.y2 + 17 AND (b.x2 - b.x1) * (b.y2 - b.y1) < 0.85 * ((a.x2 - a.x1) * (a.y2 - a.y1)) AND NOT {SHADE.format(k='a', b='b')})")
def box_wrapper_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.table_boxes(_nested(spark, sf_dir), ["doc_id"]).select("doc_id", "box_id")


# Rows widen by 36 down and 35 up (half of 72); the last band of a page may reach its end; one band is the whole page.
BANDS = "WITH a AS (SELECT DISTINCT l_suppkey, l_partkey % 2000 // (1 + l_suppkey % 40) AS y FROM lineitem), m AS (SELECT l_suppkey, y, CASE WHEN y - 35 > lag(y + 36) OVER (PARTITION BY l_suppkey ORDER BY y) + 1 THEN 1 ELSE 0 END AS new FROM a), g AS (SELECT l_suppkey, y, sum(new) OVER (PARTITION BY l_suppkey ORDER BY y) AS band FROM m), r AS (SELECT l_suppkey, CAST(band AS BIGINT) AS band, greatest(0, min(y) - 35) AS first, max(y) + 37 AS past FROM g GROUP BY l_suppkey, band)"


@query(f"{BANDS} SELECT s_suppkey AS l_suppkey, coalesce(band, 0) AS band, CASE WHEN count(*) OVER (PARTITION BY s_suppkey) = 1 THEN 0 ELSE greatest(0, first - 3) END AS top, CASE WHEN count(*) OVER (PARTITION BY s_suppkey) = 1 OR past >= 2000 THEN 2000 ELSE least(2000, past + 3) END AS bottom FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey")
def row_bands_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_partkey") % 2000 / (1 + F.col("l_suppkey") % 40)).alias("y"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(2000).alias("height"))
    return boxes.bands(rows, pages, ["l_suppkey"])


FRAMES = "SELECT doc_id, k, CASE k WHEN 2 THEN 10 ELSE k * 490 + doc_id % 40 END AS x1, 0 AS y1, CASE k WHEN 2 THEN 110 + doc_id % 3 * 200 ELSE k * 490 + doc_id % 40 + 420 + doc_id % 100 END AS x2, CASE k WHEN 1 THEN 950 - doc_id % 7 * 30 ELSE 950 END AS y2, 1000 AS page_w, 1000 AS page_h FROM documents, range(3) t(k)"


@query(f"WITH f AS (SELECT * FROM ({FRAMES}) WHERE (x2 - x1) * (y2 - y1) >= 0.25 * page_w * page_h), two AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) = 2) SELECT a.doc_id FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.x1 < b.x1 WHERE a.doc_id IN (SELECT doc_id FROM two) AND (a.x2 - a.x1) * (a.y2 - a.y1) > 400000 AND (a.x2 - a.x1) * (a.y2 - a.y1) < 550000 AND (b.x2 - b.x1) * (b.y2 - b.y1) > 400000 AND (b.x2 - b.x1) * (b.y2 - b.y1) < 550000 AND greatest((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) <= 1.2 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AND (a.x1 + a.x2) / 2.0 < 500 AND (b.x1 + b.x2) / 2.0 > 500 AND a.x2 - b.x1 <= 0.05 * least(a.x2 - a.x1, b.x2 - b.x1)")
def double_page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.double_pages(_frames(spark, sf_dir), ["doc_id"])


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    side = F.col("k") * 490 + F.col("doc_id") % 40
    x1 = F.when(F.col("k") == 2, F.lit(10)).otherwise(side)
    x2 = F.when(F.col("k") == 2, 110 + F.col("doc_id") % 3 * 200).otherwise(side + 420 + F.col("doc_id") % 100)
    y2 = F.when(F.col("k") == 1, 950 - F.col("doc_id") % 7 * 30).otherwise(F.lit(950))
    return d.select("doc_id", x1.alias("x1"), F.lit(0).alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(1000).alias("page_w"), F.lit(1000).alias("page_h"))


@query("SELECT p_partkey, CAST(i - 1 AS BIGINT) AS ord, CASE WHEN regexp_full_match(w, '[\\s|L_;*]*') THEN '' ELSE w END AS value, CAST((p_partkey * 7 + i - 1) % 100 AS BIGINT) AS confidence, (i - 1) * 100 AS x1, p_partkey % 50 AS y1, (i - 1) * 100 + 80 AS x2, p_partkey % 50 + 20 AS y2 FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part)")
def hocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    span = lambda w, i: F.concat(F.lit('<span class="ocrx_word" title="bbox '), (i * 100).cast("string"), F.lit(" "), (F.col("p_partkey") % 50).cast("string"), F.lit(" "), (i * 100 + 80).cast("string"), F.lit(" "), (F.col("p_partkey") % 50 + 20).cast("string"), F.lit("; x_wconf "), ((F.col("p_partkey") * 7 + i) % 100).cast("string"), F.lit('">'), w, F.lit("</span>"))
    xml = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split("p_type", " "), span), ""), F.lit("</body></html>"))
    w = sources.recognised_words(p.select("p_partkey", xml.alias("xml")), "p_partkey", "xml")
    return w.select("p_partkey", "value", *(F.col(c).cast("long").alias(c) for c in ("ord", "confidence", "x1", "y1", "x2", "y2")))


# ---- pages, sections, positions ----------------------------------------------------------------------

MARK = r"\[!@#\$%\]EOP[0-9]+\[!@#\$%\]"
PIECES = f"SELECT file_id, unnest(string_split_regex(pure_text, '{MARK}')) AS body, generate_subscripts(string_split_regex(pure_text, '{MARK}'), 1) AS i, regexp_extract_all(pure_text, '{MARK}') AS marks FROM files"
PAGES = f"SELECT file_id, i - 1 AS page, CAST(sum(length(body) + coalesce(length(marks[i]), 0)) OVER (PARTITION BY file_id ORDER BY i) - length(body) - coalesce(length(marks[i]), 0) AS BIGINT) AS start, length(body) AS chars, len(marks) AS n, body FROM ({PIECES})"


@query(f"SELECT file_id, page, start, chars FROM ({PAGES}) WHERE chars > 0 OR page < n")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.page_spans(table(spark, sf_dir, "files"), "file_id", "pure_text")


@query(f"SELECT h.file_id, h.pos, p.page FROM ({_hits('pressure')}) h JOIN ({PAGES}) p ON p.file_id = h.file_id AND h.pos >= p.start AND h.pos < p.start + p.chars")
def hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.page_of(literal_occurrences(spark, sf_dir), page_spans(spark, sf_dir), "file_id")


@query(f"SELECT DISTINCT h.file_id, p.page, p.body AS snippet FROM ({_hits('pressure')}) h JOIN ({PAGES}) p ON p.file_id = h.file_id AND h.pos >= p.start AND h.pos < p.start + p.chars")
def page_bounds_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.snippets(table(spark, sf_dir, "files"), "file_id", "pure_text", "pressure")


@query("SELECT file_id, page AS phys_page, sub, row_number() OVER (PARTITION BY file_id ORDER BY page, sub) - 1 AS logical_page FROM (SELECT file_id, page, unnest(CASE WHEN (file_id + page) % 4 = 0 THEN [0, 1] ELSE [0] END) AS sub FROM (SELECT file_id, unnest(range(0, pages)) AS page FROM files WHERE pages > 0))")
def logical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "files").filter("pages > 0").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1)).alias("phys_page"))
    return boxes.logical_pages(p, "file_id", p.filter("(file_id + phys_page) % 4 = 0"))


@query(HEADS)
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.headings(table(spark, sf_dir, "files"))


@query(f"SELECT file_id, ord, heading FROM (SELECT file_id, ord, heading || CASE WHEN ord % 3 = 0 THEN '.....12' WHEN ord % 3 = 1 THEN '.....' ELSE '' END AS heading FROM ({HEADS})) WHERE NOT (heading LIKE '%.....' OR left(heading, -3) LIKE '%.....')")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_parse(spark, sf_dir)
    end = F.when(F.col("ord") % 3 == 0, ".....12").when(F.col("ord") % 3 == 1, ".....").otherwise("")
    return slicing.no_contents(h.withColumn("heading", F.concat("heading", end))).select("file_id", "ord", "heading")


@query(f"SELECT file_id, ord, regexp_extract(heading, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(.+)$', 1) AS number, regexp_extract(heading, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(.+)$', 2) AS title FROM ({HEADS})")
def header_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_parse(spark, sf_dir).select("file_id", "ord", slicing.numbered(F.col("heading")).alias("n")).select("file_id", "ord", "n.number", "n.title")


@query(f'SELECT * FROM (SELECT file_id, ord, heading, pos AS start, lead(pos) OVER (PARTITION BY file_id ORDER BY pos, ord) AS "end" FROM ({HEADS})) WHERE "end" IS NOT NULL')
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.sections(header_parse(spark, sf_dir))


PAGED = rf"SELECT h.file_id, h.ord, h.pos, h.heading, len(regexp_extract_all(substr(f.pure_text, 1, CAST(h.pos AS INTEGER)), '\[!@#\$%\]EOP[0-9]+\[!@#\$%\]')) AS page, f.pure_text AS t FROM ({HEADS}) h JOIN files f USING (file_id)"
BOUNDED = rf"SELECT *, greatest(instr(t, '[!@#$%]EOP' || (page - 1) || '[!@#$%]'), 1) AS low, instr(t, '[!@#$%]EOP' || page || '[!@#$%]') AS past, regexp_extract(heading, '^(\d+\.*)+\s+([A-ZА-Я]{{2,}})', 2) AS title, regexp_extract(heading, '^(\d+\.*)+\s+([A-ZА-Я]{{2,}})', 1) AS number FROM ({PAGED})"


@query(f"SELECT file_id, ord, page, low - 2 + hit AS pos, heading FROM (SELECT *, CASE WHEN instr(body, CASE WHEN title <> '' THEN title ELSE heading END) > 0 THEN instr(body, CASE WHEN title <> '' THEN title ELSE heading END) ELSE instr(body, CASE WHEN title <> '' THEN number ELSE substr(heading, 1, 5) END) END AS hit FROM (SELECT *, CASE WHEN past = 0 THEN substr(t, low) ELSE substr(t, low, past - low) END AS body FROM ({BOUNDED}))) WHERE hit > 0")
def header_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.anchored(_paged(spark, sf_dir))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with heads, an array of (page, text): each heading with the page on which it stands."""
    before = lambda h: F.size(F.regexp_extract_all(F.substr(F.col("pure_text"), F.lit(1), F.get(h, F.lit(0)).cast("int")), F.lit(f"({slicing.PAGE_MARK})"), F.lit(1)))
    heads = F.transform(F.from_json("headers", "array<array<string>>"), lambda h: F.struct(before(h).alias("page"), F.get(h, F.lit(1)).alias("text")))
    return table(spark, sf_dir, "files").select("file_id", "pure_text", heads.alias("heads"))


# Every heading stands for a table behind the 30 characters before it; each insertion moves the later ones.
ANCHORS = f"a AS (SELECT file_id, t, page, CAST(ord AS INTEGER) AS table_idx, substr(t, greatest(CAST(pos AS INTEGER) - 29, 1), least(30, CAST(pos AS INTEGER))) AS before, 'T-' || ord || ';U-' || page AS tags, row_number() OVER (PARTITION BY file_id ORDER BY page, ord) AS n, count(*) OVER (PARTITION BY file_id) AS many FROM ({PAGED}))"
FOUND = "CASE WHEN a.before <> '' AND contains(substr(g.text, greatest(instr(g.text, '[!@#$%]EOP' || (a.page - 1) || '[!@#$%]'), 1)), a.before) THEN greatest(instr(g.text, '[!@#$%]EOP' || (a.page - 1) || '[!@#$%]'), 1) - 1 + instr(substr(g.text, greatest(instr(g.text, '[!@#$%]EOP' || (a.page - 1) || '[!@#$%]'), 1)), a.before) - 1 + length(a.before) ELSE coalesce((SELECT max(struct_pack(k := k, place := instr(g.text, '[!@#$%]EOP' || k || '[!@#$%]') - 1 + length('[!@#$%]EOP' || k || '[!@#$%]'))).place FROM range(0, a.page) r(k) WHERE contains(g.text, '[!@#$%]EOP' || k || '[!@#$%]')), 0) END"


@query(f"WITH RECURSIVE {ANCHORS}, g AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS n, t AS text, CAST([] AS BIGINT[]) AS places FROM a UNION ALL SELECT file_id, n, substr(text, 1, CAST(p AS BIGINT)) || tags || substr(text, CAST(p AS BIGINT) + 1), list_append(places, p + length(tags)) FROM (SELECT g.file_id, a.n, g.text, g.places, a.tags, {FOUND} AS p FROM g JOIN a ON a.file_id = g.file_id AND a.n = g.n + 1)) SELECT g.file_id, g.text, array_to_string(g.places, ',') AS indexes FROM g JOIN (SELECT DISTINCT file_id, many FROM a) m ON m.file_id = g.file_id AND g.n = m.many")
def insert_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_parse(spark, sf_dir)
    pages = _paged(spark, sf_dir).select("file_id", "pure_text", F.posexplode("heads").alias("ord", "h")).select("file_id", "pure_text", "ord", "h.page")
    rows = pages.join(h, ["file_id", "ord"])
    at = F.col("pos").cast("int")
    before = F.substr(F.col("pure_text"), F.greatest(at - 29, F.lit(1)), F.least(F.lit(30), at))
    anchor = F.struct("page", F.col("ord").alias("table_idx"), before.alias("before"), F.array(F.concat(F.lit("T-"), F.col("ord"), F.lit(";U-"), F.col("page"))).alias("passport_tags"), F.array().cast("array<string>").alias("tags"))
    files = rows.groupBy("file_id").agg(F.first("pure_text").alias("text"), F.collect_list(anchor).alias("anchors"))
    return slicing.insert_tables(files).select("file_id", "text", F.array_join("indexes", ",").alias("indexes"))


@query(f"SELECT file_id, ord, heading FROM ({HEADS}) h WHERE NOT EXISTS (SELECT 1 FROM ({HEADS}) c WHERE c.file_id = h.file_id AND c.ord % 2 = 1 AND c.heading = h.heading)")
def headers_in_tables_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_parse(spark, sf_dir)
    return h.join(h.filter("ord % 2 = 1").select("file_id", "heading").distinct(), ["file_id", "heading"], "left_anti").select("file_id", "ord", "heading")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_parse(spark, sf_dir).select("file_id", F.col("ord").alias("table_idx"), F.col("pos").alias("index"))


@query(f"SELECT file_id, target, table_idx, distance FROM (SELECT t.file_id, t.pos AS target, h.ord AS table_idx, h.pos - t.pos AS distance FROM ({_hits('pressure')}) t JOIN ({HEADS}) h ON h.file_id = t.file_id AND h.pos >= t.pos AND h.pos < t.pos + 1024) QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY distance, table_idx) = 1")
def next_table_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.next_within(literal_occurrences(spark, sf_dir).withColumnRenamed("pos", "target"), _tables(spark, sf_dir))


@query(f"SELECT file_id, target, table_idx FROM (SELECT t.file_id, t.target, h.ord AS table_idx, abs(h.pos - t.target) AS d FROM (SELECT file_id, min(pos) AS target FROM ({_hits('pressure')}) GROUP BY file_id) t JOIN ({HEADS}) h ON h.file_id = t.file_id) QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY d, table_idx) = 1")
def nearest_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = literal_occurrences(spark, sf_dir).groupBy("file_id").agg(F.min("pos").alias("target"))
    return slicing.nearest(first, _tables(spark, sf_dir))


PLACES = r"(SELECT file_id, i, CAST(sum(length(gap) + coalesce(length(t[i]), 0)) OVER (PARTITION BY file_id ORDER BY i) - coalesce(length(t[i]), 0) AS BIGINT) AS p, t[i] AS raw FROM (SELECT file_id, unnest(string_split_regex(pure_text, '(?:[A-Z0-9]+-)+(?:[A-Z0-9]+)')) AS gap, generate_subscripts(string_split_regex(pure_text, '(?:[A-Z0-9]+-)+(?:[A-Z0-9]+)'), 1) AS i, regexp_extract_all(pure_text, '(?:[A-Z0-9]+-)+(?:[A-Z0-9]+)') AS t FROM files))"
TAG_AT = f"SELECT file_id, tag, pos FROM (SELECT file_id, CASE WHEN regexp_matches(raw, '^E-[0-9]') THEN substr(raw, 3) ELSE raw END AS tag, p + CASE WHEN regexp_matches(raw, '^E-[0-9]') THEN 2 ELSE 0 END AS pos FROM {PLACES} WHERE raw IS NOT NULL) WHERE {VALID}"


@query(TAG_AT)
def tag_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.tag_places(table(spark, sf_dir, "files"), "file_id", "pure_text")


@query(f'WITH t AS (SELECT *, substr(tag, 1, greatest(length(tag) - 1, 1)) AS stem FROM ({TAG_AT})) SELECT a.file_id, a.tag, a.pos, min(b.pos) AS "end" FROM t a LEFT JOIN t b ON b.file_id = a.file_id AND b.pos > a.pos AND b.stem <> a.stem GROUP BY a.file_id, a.tag, a.pos')
def next_other_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.next_other(tag_places(spark, sf_dir), "file_id")


# Places of one tag before the same other tag are one slice, from the first of them; the rest of the text is one too; 120 characters are too few.
SLICES = f'SELECT file_id, tag, row_number() OVER (PARTITION BY file_id, tag ORDER BY start) - 1 AS ord, start, "end" FROM (SELECT p.file_id, p.tag, min(p.pos) AS start, coalesce(p."end", length(any_value(f.pure_text))) AS "end" FROM (SELECT a.file_id, a.tag, a.pos, min(b.pos) AS "end" FROM (SELECT *, substr(tag, 1, greatest(length(tag) - 1, 1)) AS stem FROM ({TAG_AT}) WHERE {{which}}) a LEFT JOIN (SELECT *, substr(tag, 1, greatest(length(tag) - 1, 1)) AS stem FROM ({TAG_AT}) WHERE {{which}}) b ON b.file_id = a.file_id AND b.pos > a.pos AND b.stem <> a.stem GROUP BY a.file_id, a.tag, a.pos) p JOIN files f USING (file_id) GROUP BY p.file_id, p.tag, p."end") WHERE "end" - start > 120'
LISTED = "tag IN (SELECT trim(ltrim(tag, chr(65279)), ' ') FROM tags WHERE tag IS NOT NULL)"


@query(SLICES.replace("{which}", "true"))
def tag_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.tag_slices(table(spark, sf_dir, "files"), "file_id", "pure_text")


@query(SLICES.replace("{which}", LISTED))
def registry_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.tag_slices(table(spark, sf_dir, "files"), "file_id", "pure_text", tag_registry(spark, sf_dir))


@query(f"""SELECT s.file_id, s.tag, string_agg(substr(f.pure_text, CAST(s.start AS BIGINT) + 1, CAST(s."end" - s.start AS BIGINT)) || '(!@#$)EOF;' || s.start || ';' || s."end" || ';(!@#$)', chr(10) ORDER BY s.ord) AS text FROM ({SLICES.replace("{which}", LISTED)}) s JOIN files f USING (file_id) GROUP BY s.file_id, s.tag""")
def slice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.slice_texts(table(spark, sf_dir, "files"), registry_slices(spark, sf_dir), "file_id", "pure_text")


def _doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table_cells(spark, sf_dir)
    tags = slicing.tags_by_text(cells.select("file_id", "table_idx", "value").withColumn("key", F.struct("file_id", "table_idx")), "key", "value").groupBy("key").agg(F.collect_set("tag").alias("tags")).select("key.*", "tags")
    return search.gathered_cells(cells, ["file_id", "table_idx", "index"]).join(tags, ["file_id", "table_idx"], "left")


@query(f"""SELECT DISTINCT s.file_id, s.tag, t.table_idx FROM ({SLICES.replace("{which}", LISTED)}) s JOIN (SELECT file_id, table_idx, any_value(index) AS index, list_distinct(flatten(list(regexp_extract_all(value, '{TAG}', 1)))) AS tags FROM ({TABLE_CELLS.replace("{HEADS}", HEADS)}) GROUP BY file_id, table_idx) t ON t.file_id = s.file_id AND (t.index BETWEEN s.start AND s."end" OR list_contains(t.tags, s.tag))""")
def tables_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.tables_of_slices(registry_slices(spark, sf_dir), _doc_tables(spark, sf_dir))


@query(f"""SELECT s.file_id, s.tag, h.ord, h.pos - s.start AS pos, h.heading FROM ({SLICES.replace("{which}", LISTED)}) s JOIN ({HEADS}) h ON h.file_id = s.file_id AND h.pos BETWEEN s.start AND s."end" QUALIFY row_number() OVER (PARTITION BY s.file_id, s.tag, h.ord ORDER BY s.ord) = 1""")
def headings_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.headings_of_slices(registry_slices(spark, sf_dir), header_parse(spark, sf_dir))


@query(f"""SELECT file_id, table_idx, tag FROM (SELECT file_id, table_idx, string_agg(value, ' ' ORDER BY row_idx) AS t FROM ({TABLE_CELLS.replace("{HEADS}", HEADS)}) GROUP BY file_id, table_idx), (SELECT DISTINCT trim(ltrim(tag, chr(65279)), ' ') AS tag FROM tags WHERE trim(ltrim(tag, chr(65279)), ' ') <> '') WHERE contains(lower('Паспорт ' || t), 'паспорт') AND contains('Паспорт ' || t, tag)""")
def passport_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables get a first cell that makes them passports."""
    title = F.array(F.struct(F.lit(-1).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("line").alias("col_label"), F.lit("Паспорт").alias("value"))).cast(search.CELLS)
    tables = _doc_tables(spark, sf_dir).withColumn("cells", F.concat(title, F.col("cells")))
    return strategies.passport_tags(tables, tag_registry(spark, sf_dir))


@query("SELECT DISTINCT tag FROM (SELECT trim(ltrim(tag, chr(65279)), ' ') AS tag FROM tags UNION ALL SELECT regexp_replace(trim(tag_number, ' '), '^E-', '') FROM register) WHERE tag <> ''")
def registry_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the register's tags."""
    return tag_registry(spark, sf_dir).union(store.prepared(table(spark, sf_dir, "register")).select("tag")).distinct()


@query(f"SELECT file_id, count(*) AS parts, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (WHERE chars > 1000) AS large FROM (SELECT * FROM ({PAGES}) WHERE chars > 0 OR page < n) GROUP BY file_id")
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_spans(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("parts"), F.sum("chars").alias("chars"), F.count_if(F.col("chars") > 1000).alias("large"))


KEYS = ["pressure", "temperature", "давление", "температура", "material", "материал"]


@query("SELECT file_id, CAST(" + " + ".join(f"CAST(contains(lower(pure_text), '{k}') AS INT)" for k in KEYS) + " AS BIGINT) AS matched FROM files WHERE (" + " + ".join(f"CAST(contains(lower(pure_text), '{k}') AS INT)" for k in KEYS) + ") > 1")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("pure_text")
    n = sum((t.contains(k).cast("long") for k in KEYS[1:]), t.contains(KEYS[0]).cast("long"))
    return table(spark, sf_dir, "files").select("file_id", n.alias("matched")).filter("matched > 1")


@query(f"SELECT file_id, coalesce(min(p), 0) AS first_mention FROM files f LEFT JOIN (SELECT file_id AS k, pos AS p FROM ({_hits('pressure')})) h ON h.k = f.file_id GROUP BY file_id")
def first_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = literal_occurrences(spark, sf_dir).groupBy("file_id").agg(F.min("pos").alias("p"))
    return table(spark, sf_dir, "files").select("file_id").join(h, "file_id", "left").select("file_id", F.coalesce("p", F.lit(0)).alias("first_mention"))


# ---- search in tables and by tokens -------------------------------------------------------------------

CELLS = "SELECT p_partkey AS table_id, 0 AS row_idx, c AS col_idx, ['name', 'brand', 'type'][c + 1] AS col_label, [p_name, p_brand, p_type][c + 1] AS value FROM part, range(3) t(c)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("table_id"), F.lit(0).cast("long").alias("row_idx"), F.posexplode(F.array(F.struct(F.lit("name").alias("l"), F.col("p_name").alias("v")), F.struct(F.lit("brand").alias("l"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("l"), F.col("p_type").alias("v")))).alias("col_idx", "x")).select("table_id", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), F.col("x.l").alias("col_label"), F.col("x.v").alias("value"))


# One word stands once for every place, so its cells are those that hold it; a label's hits count for the first row.
@query(f"SELECT table_id, row_idx, col_idx, value FROM ({CELLS}) WHERE list_contains(regexp_extract_all(lower(value), '\\p{{L}}+'), 'small') OR (row_idx = 0 AND list_contains(regexp_extract_all(lower(col_label), '\\p{{L}}+'), 'small'))")
def table_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    found = search.table_search(search.gathered_cells(cells, ["table_id"]).withColumn("phrase", F.lit("the small")), "cells", "phrase")
    at = found.select("table_id", F.explode("points").alias("p")).select("table_id", F.col("p.row_idx").cast("long").alias("row_idx"), F.col("p.col_idx").cast("long").alias("col_idx"))
    return at.join(cells, ["table_id", "row_idx", "col_idx"]).select("table_id", "row_idx", "col_idx", "value")


@query("SELECT table_id, string_agg(l, chr(10) ORDER BY o) AS text FROM (SELECT p_brand AS table_id, '| ' || p_type || ' | ' || p_size || ' |' AS l, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY table_id")
def table_repr_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row_idx"), F.posexplode(F.array("p_type", F.col("p_size").cast("string"))).alias("col_idx", "value"))
    return contexts.table_text(cells, "markdown")


@query("SELECT p_brand, p_type, p_size, min(p_partkey) AS first_row FROM part GROUP BY p_brand, p_type, p_size")
def table_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("first_row"))


@query("SELECT p_brand, count(DISTINCT p_type) + CAST(bool_or(p_type IS NULL) AS INT) AS values FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) + CAST(bool_or(p_type IS NULL) AS INT) >= 4")
def table_min_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.countDistinct("p_type") + F.max(F.col("p_type").isNull().cast("int"))).alias("values"))
    return g.filter("values >= 4")


@query()
def proximity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_search(table(spark, sf_dir, "files").select("file_id", "pure_text", F.lit("spare parts for two years").alias("phrase")), "file_id", "pure_text", "phrase")


@query()
def token_subset_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.specific_search(table(spark, sf_dir, "files").select("file_id", "pure_text", F.lit("design pressure of the gas filter").alias("phrase")), "file_id", "pure_text", "phrase")


# ---- cascade --------------------------------------------------------------------------------------------


@query("SELECT doc_id, b - 1 AS batch_no, CASE WHEN n < 10000 THEN 0 ELSE (b - 1) * 10000 END AS start, CASE WHEN n < 10000 THEN n ELSE least((b - 1) * 10000 + 11000, n) - (b - 1) * 10000 END AS chars FROM (SELECT doc_id, n, unnest(range(1, CASE WHEN n < 10000 THEN 2 WHEN n > 100000 THEN 1 ELSE 2 + (n - 501) // 10000 END)) AS b FROM (SELECT doc_id, CAST(length(text) * 15 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL))")
def llm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.repeat("text", F.lit(15)).alias("text"))
    return cascade.batches(d, "doc_id", "text").select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("batch_no", "start", "chars")))


REPLY = "CASE row_id % 4 WHEN 0 THEN '```json' || chr(10) || json_object('value', property_value, 'uom', coalesce(uom, '')) || chr(10) || '```' WHEN 1 THEN json_object('value', property_value, 'uom', coalesce(uom, '')) WHEN 2 THEN 'not a reply' ELSE '{\"value\": ' END"


@query("SELECT row_id, CASE WHEN row_id % 4 < 2 THEN property_value ELSE 'NOANS' END AS value, CASE WHEN row_id % 4 < 2 THEN coalesce(uom, '') ELSE 'NOANS' END AS uom FROM register WHERE property_value IS NOT NULL")
def llm_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "register").filter("property_value is not null")
    good = F.to_json(F.struct(F.col("property_value").alias("value"), F.coalesce("uom", F.lit("")).alias("uom")))
    k = F.col("row_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 1, good).when(k == 2, "not a reply").otherwise('{"value": ')
    return r.select("row_id", cascade.parse_reply(reply).alias("p")).select("row_id", "p.value", "p.uom")


NO = ", ".join("'" + x.replace("'", "''") + "'" for x in cascade.NO_ANSWERS)


@query(f"SELECT row_id, coalesce(property_value NOT IN ({NO}) AND NOT starts_with(property_value, 'NOANS') AND NOT ends_with(property_value, 'NOANS') AND NOT starts_with(property_value, '```'), false) AS valid, coalesce(property_value NOT IN ({NO}), false) AND coalesce(property_value IN ('yes', 'no', 'да'), false) AS listed FROM register")
def result_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("property_value")
    return table(spark, sf_dir, "register").select("row_id", cascade.is_valid(v).alias("valid"), cascade.is_valid(v, F.array(F.lit("yes"), F.lit("no"), F.lit("да"))).alias("listed"))


WAYS = [("table_en", "property_value"), ("simple_en", "uom"), ("tokens_en", "property_description_rus")]
EVERY = " UNION ALL ".join(f"SELECT row_id, {c} AS value, {n!r} AS strategy, {cascade.CONFIDENCE[n]} AS confidence FROM register" for n, c in WAYS)


@query(f"SELECT row_id, value, strategy, CAST(confidence AS DOUBLE) AS confidence FROM ({EVERY}) WHERE value IS NOT NULL AND value NOT IN ({NO}) AND NOT starts_with(value, 'NOANS') AND NOT ends_with(value, 'NOANS') AND NOT starts_with(value, '```') QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY confidence DESC, strategy DESC) = 1")
def cascade_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every register row with its value, unit and description as the answers of three strategies."""
    each = F.explode(F.array(*(F.struct(F.col(c).alias("value"), F.lit(n).alias("strategy"), F.lit(cascade.CONFIDENCE[n]).alias("confidence")) for n, c in WAYS)))
    c = table(spark, sf_dir, "register").select("row_id", each.alias("c")).select("row_id", "c.*")
    return cascade.best_answers(c.withColumn("possible", F.lit(None).cast("array<string>")).withColumn("uom", F.lit(""))).select("row_id", "value", "strategy", "confidence")


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, tasks, keywords): register rows with the tag of the registry and the property they mean; the questions they ask, in every file that mentions the tag; their keywords.

    Rows that ask the same of the same tag are asked once, under the least row_id.
    """
    keyed = registry(table(spark, sf_dir, "tags"))
    properties = table(spark, sf_dir, "properties")
    register = table(spark, sf_dir, "register").filter("tag_number is not null")
    meant = with_property(register, properties, ["row_id", "tag_number"])
    rows = meant.select("row_id", "prop_id", tag_key(F.col("tag_number")).alias("tag_key")).join(keyed, "tag_key").select("row_id", "prop_id", F.col("tag_number").alias("tag"))
    mentions = slicing.tags_by_text(table(spark, sf_dir, "files"), "file_id", "pure_text").join(keyed.select(F.col("tag_number").alias("tag")), "tag")
    rows = cut(rows.join(mentions.select("tag").distinct(), "tag", "left_semi"))
    questions = rows.groupBy("tag", "prop_id").agg(F.min("row_id").alias("row_id"))
    items = store.allowed_lists(table(spark, sf_dir, "validations"), table(spark, sf_dir, "allowed_items"))
    listed = lambda c, name: items.filter(F.col("target_col") == c).groupBy("prop_id").agg(F.first("items").alias(name))
    known = properties.select("prop_id", F.coalesce("prop_name_eng", F.lit("")).alias("name_en"), F.nullif(F.coalesce("prop_name_rus", F.lit("")), F.lit("none")).alias("name_ru"), F.col("search_condition").alias("condition"), F.coalesce("desc_for_llm", F.lit("")).alias("hint"))
    known = known.join(listed("property_value", "values"), "prop_id", "left").join(listed("uom", "units"), "prop_id", "left")
    known = known.withColumn("possible", F.lit(None).cast("array<string>")).withColumn("kind", F.lit("")).fillna("", ["name_ru"])
    tasks = cut(questions.join(mentions, "tag").join(known, "prop_id").drop("prop_id"))
    words = properties.select("prop_id", F.posexplode(store.keyword_list(F.col("alt_keywords"))).alias("keyword_no", "keyword"))
    return rows, tasks, questions.join(words, "prop_id").select("row_id", "keyword_no", "keyword")


def _material(spark: SparkSession, sf_dir: str, tasks: DataFrame) -> strategies.Material:
    files = table(spark, sf_dir, "files").select("file_id", "pure_text")
    m = strategies.preload(files, header_parse(spark, sf_dir), cut(_doc_tables(spark, sf_dir)), tag_registry(spark, sf_dir), tasks)
    slices = cut(m.slices)
    return strategies.Material(slices, cut(m.texts), cut(m.tables), cut(m.passports), m.headings, cut(m.sections))


@query(f"""WITH s AS ({SLICES.replace("{which}", LISTED)}), tb AS (SELECT file_id, table_idx, any_value(index) AS index, list_distinct(flatten(list(regexp_extract_all(value, '{TAG}', 1)))) AS tags FROM ({TABLE_CELLS.replace("{HEADS}", HEADS)}) GROUP BY file_id, table_idx) SELECT file_id, tag, count(*) AS slices, CAST(sum("end" - start) AS BIGINT) AS chars, (SELECT count(DISTINCT t.table_idx) FROM tb t JOIN s x ON t.file_id = x.file_id WHERE x.file_id = s.file_id AND x.tag = s.tag AND (t.index BETWEEN x.start AND x."end" OR list_contains(t.tags, x.tag))) AS tables, (SELECT count(DISTINCT h.ord) FROM ({HEADS}) h JOIN s x ON h.file_id = x.file_id WHERE x.file_id = s.file_id AND x.tag = s.tag AND h.pos BETWEEN x.start AND x."end") AS headings FROM s GROUP BY file_id, tag""")
def preload_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each file says of each registry tag that it mentions."""
    files = table(spark, sf_dir, "files")
    tasks = slicing.tags_by_text(files, "file_id", "pure_text").join(tag_registry(spark, sf_dir), "tag", "left_semi")
    m = strategies.preload(files, header_parse(spark, sf_dir), _doc_tables(spark, sf_dir), tag_registry(spark, sf_dir), tasks)
    key = ["file_id", "tag"]
    out = m.slices.groupBy(*key).agg(F.count("*").alias("slices"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    for name, d in (("tables", m.tables), ("headings", m.headings)):
        out = out.join(d.groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, ["tables", "headings"])


def _attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, tasks, keywords = _tasks(spark, sf_dir)
    return rows, tasks, cut(strategies.solve_register(tasks, _material(spark, sf_dir, tasks), cascade.RuleExtractor(), keywords))


@query()
def register_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register with what all tiers of the cascade find in the files, answered by the offline extractor."""
    rows, _, tried = _attempts(spark, sf_dir)
    asked = rows.groupBy("tag", "prop_id").agg(F.min("row_id").alias("first"))
    answers = tried.filter("valid").select(F.col("row_id").alias("first"), "value", F.when(F.col("uom") != "NOANS", F.col("uom")).alias("uom")).join(asked, "first").drop("first").join(rows, ["tag", "prop_id"]).select("row_id", "value", "uom")
    return cascade.fill(table(spark, sf_dir, "register").select("row_id", "property_value", "uom"), answers)


@query()
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tasks, tried = _attempts(spark, sf_dir)
    return cascade.summary(tasks, tried)


@query("SELECT file_id, page FROM (SELECT file_id, unnest(range(0, pages)) AS page FROM files WHERE pages > 0) WHERE page BETWEEN 1 AND 3 AND (file_id * 31 + page) % 4 <> 0")
def page_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").filter("pages > 0").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1)).alias("page"))
    return sources.not_done(f.filter("page between 1 and 3"), f.filter("(file_id * 31 + page) % 4 = 0"))


@query(f"SELECT h.file_id, h.ord, CAST(nullif(regexp_extract(substr(f.pure_text, CAST(h.pos AS INTEGER) + 1), 'EOP(\\d+)', 1), '') AS BIGINT) AS page FROM ({HEADS}) h JOIN files f USING (file_id)")
def dump_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_parse(spark, sf_dir).join(table(spark, sf_dir, "files").select("file_id", "pure_text"), "file_id")
    rest = F.substring(F.col("pure_text"), F.col("pos").cast("int") + 1, F.length("pure_text"))
    return h.select("file_id", "ord", F.nullif(F.regexp_extract(rest, r"EOP(\d+)", 1), F.lit("")).cast("long").alias("page"))


# ---- rules of the tables, contexts -----------------------------------------------------------------------


@query("SELECT file_id, unnest(['pages_positive']) AS rule FROM (SELECT file_id, pages - 3 AS pages FROM files) WHERE pages <= 0 UNION ALL SELECT file_id, 'text_given' FROM files WHERE pure_text IS NULL")
def table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.violations(table(spark, sf_dir, "files").withColumn("pages", F.col("pages") - 3), "files", "file_id")


@query("SELECT tag_number, count(*) AS n FROM register WHERE tag_number IS NOT NULL GROUP BY tag_number HAVING count(*) > 1")
def table_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.repeated(table(spark, sf_dir, "register"), "tag_number")


NAMED = " OR ".join(f"contains(lower(heading), '{s}')" for s in contexts.TECHNICAL)


@query(f'WITH h AS ({HEADS}), s AS (SELECT file_id, heading, pos AS start, lead(pos) OVER (PARTITION BY file_id ORDER BY pos, ord) AS "end" FROM h), g AS (SELECT file_id, min(start) AS start, arg_min("end", start) AS "end" FROM s WHERE "end" IS NOT NULL AND ({NAMED}) AND ("end" - start >= 1024 OR EXISTS (SELECT 1 FROM h t WHERE t.file_id = s.file_id AND t.ord % 2 = 1 AND t.pos >= s.start AND t.pos < s.start + 1024)) GROUP BY file_id) SELECT file_id, start, "end" FROM g WHERE "end" - start <= 15000')
def technical_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.technical_sections(header_parse(spark, sf_dir), _tables(spark, sf_dir).filter("table_idx % 2 = 1"))


def _nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    both = F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))
    return n.select((F.col("n_nationkey") % 4).cast("long").alias("table_id"), F.col("n_nationkey").cast("long").alias("row_idx"), F.posexplode(both).alias("col_idx", "value"))


@query("SELECT n_nationkey % 4 AS table_id, '<table>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS text FROM nation GROUP BY 1")
def table_repr_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.table_text(_nation_cells(spark, sf_dir))


@query("SELECT n_nationkey % 4 AS table_id, '[' || string_agg('[\"' || n_name || '\",\"' || n_regionkey || '\"]', ',' ORDER BY n_nationkey) || ']' AS text FROM nation GROUP BY 1")
def table_repr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.table_text(_nation_cells(spark, sf_dir), "json")


@query(f"SELECT coalesce(s.file_id, t.file_id) AS file_id, concat_ws(chr(10), 'Отрывки:' || chr(10) || s.x, 'Таблицы:' || chr(10) || t.x) AS context FROM (SELECT file_id, string_agg(heading, chr(10) ORDER BY ord) AS x FROM ({HEADS}) WHERE ord < 3 GROUP BY file_id) s FULL JOIN (SELECT file_id, string_agg(heading, chr(10) ORDER BY ord) AS x FROM ({HEADS}) WHERE ord >= 2 GROUP BY file_id) t ON s.file_id = t.file_id")
def context_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header_parse(spark, sf_dir).select("file_id", "ord", F.col("heading").alias("text"))
    return contexts.frames(h.filter("ord < 3"), h.filter("ord >= 2"), "file_id")


LAST_NEWLINE, LAST_SPACE = (f"CASE WHEN contains(w, {c}) THEN i + length(w) - instr(reverse(w), {c}) END" for c in ("chr(10)", "' '"))


@query(f"WITH RECURSIVE g AS (SELECT file_id, pure_text AS t, CAST(-1 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS past FROM files WHERE length(pure_text) > 0 UNION ALL SELECT file_id, t, chunk_no, i, CASE WHEN length(t) < 1000 THEN length(t) ELSE coalesce({LAST_NEWLINE}, {LAST_SPACE}, least(i + 1000, length(t))) END FROM (SELECT *, substr(t, i + 1, 1000) AS w FROM (SELECT file_id, t, chunk_no + 1 AS chunk_no, CASE WHEN substr(t, past + 1, 1) IN (' ', chr(10)) AND length(t) >= 1000 THEN past + length(regexp_extract(substr(t, past + 1), '^\\s*')) ELSE past END AS i FROM g WHERE past < length(t)) WHERE i < length(t))) SELECT file_id, chunk_no, start, past - start AS chars FROM g WHERE chunk_no >= 0")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.chunks(table(spark, sf_dir, "files"), "file_id", "pure_text", 1000)


@query("SELECT file_id, page FROM (SELECT file_id, pages, unnest(range(0, pages)) AS page FROM files WHERE pages > 0) WHERE page BETWEEN greatest(1, 0) AND least(3, pages - 1)")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("file_id", F.col("pages").cast("long").alias("pages"))
    return sources.page_range(f, 1, 3).select("file_id", "page")


@query(f"WITH b AS ({NESTED}) SELECT doc_id, box_id FROM b WHERE x2 - x1 >= 250 AND y2 - y1 >= 250")
def box_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.large_enough(_nested(spark, sf_dir), 250).select("doc_id", "box_id")
