"""Whole results where a query or operator once gave a part."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagloom.operators import cascade

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_tasks_by_tag_keeps_hot_tags(spark, tmp_path):
    r = spark.range(30_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 != 1, F.concat(F.lit("A-"), (F.col("id") % 700).cast("string"))).alias("tag_number"))
    r.write.parquet(str(tmp_path / "register.parquet"))
    sql = ORACLES["tasks_by_tag"]
    cols = ["tag", "tasks", "first_row", "rows"]
    want = duckdb.sql(f"WITH register AS (FROM '{tmp_path}/register.parquet/*.parquet') SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    got = _rows(QUERIES["tasks_by_tag"](spark, str(tmp_path)), cols)
    assert got == sorted(want, key=repr) and max(x[1] for x in got) == 10_000


def test_solve_asks_all_contexts(spark):
    t = spark.createDataFrame([(1, "length", None, "", None), (2, "length", None, "", None)], "row_id long, name string, values string, hint string, possible array<string>")
    c = spark.createDataFrame([(1, "a length, not given", 1), (1, "length: 7 mm", 3), (1, "b length: 8 mm", 2), (2, "длина: 9 мм", 1)], "row_id long, context string, ord int")
    s = [("simple_en", 0.6, c.filter("row_id = 1")), ("simple_ru", 0.5, c.filter("row_id = 2").withColumn("name", F.lit("длина")))]
    assert sorted(tuple(r)[:4] for r in cascade.solve(t, s, cascade.RuleExtractor()).collect()) == [(1, "8", "mm", "simple_en"), (2, "9", "мм", "simple_ru")]
    assert cascade.attempts(t, s, cascade.RuleExtractor()).count() == 3  # nothing is asked behind the first answer


def test_register_fill_reads_later_pages_and_typed_names(spark, tmp_path):
    mark, pad = "[!@#$%]EOP{}[!@#$%]", "word " * 40
    text = f"A-1 {pad}\n{mark.format(0)}предел: 4 бар\nweight: 3 kg\n{mark.format(1)}B-2 {pad}\nDry mass: 6 kg\n{mark.format(2)}"

    def write(name, rows, kinds):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("files", [(1, text, None)], "file_id long, pure_text string, headers string")
    write("tags", [(1, "A-1"), (2, "B-2")], "line_no long, tag string")
    kinds = "prop_id long, prop_name_eng string, prop_name_rus string, alt_keywords string, search_condition string, desc_for_llm string"
    write("properties", [(1, "dry mass", "сухая масса", "none", "none", None), (2, "total limit", "предел", "none", None, ""), (3, "gross load", "груз", "other;weight", "none", "hint")], kinds)
    write("validations", [(1, "uom", "masses")], "prop_id long, target_col string, list_name string")
    write("allowed_items", [(1, "masses", "kg")], "item_id int, list_name string, item string")
    rows = [(1, "B-2", "dry_mas", None), (2, "A-1", "total limit", "предел"), (3, "A-1", "gross load", None), (4, "B-2", "Dry mass", None), (5, "B-2", "dry_mas", None), (6, None, "dry mass", None), (7, "B-2", "gross load", None)]
    reg = spark.createDataFrame(rows, "row_id long, tag_number string, property_name string, property_name_rus string")
    reg.withColumn("property_value", F.lit("old")).withColumn("uom", F.lit("x")).write.parquet(str(tmp_path / "register.parquet"))
    got = _rows(QUERIES["register_fill"](spark, str(tmp_path)), ["row_id", "property_value", "uom"])
    assert got == [(1, "6", "kg"), (2, "4", "бар"), (3, "3", "kg"), (4, "6", "kg"), (5, "6", "kg"), (6, "old", "x"), (7, "old", "x")]
    assert _rows(QUERIES["run_summary"](spark, str(tmp_path)), ["tasks", "solved", "failed", "prompts"]) == [(4, 3, 1, 3)]


def test_cascade_best_answers_every_row(spark, tmp_path):
    r = spark.range(3_000).select(F.col("id").alias("row_id"), F.lit("N/A").alias("property_value"), F.lit("kg").alias("uom"), F.lit("mass").alias("property_description_rus"))
    r.write.parquet(str(tmp_path / "register.parquet"))
    assert QUERIES["cascade_best"](spark, str(tmp_path)).filter("value = 'kg'").count() == 3_000
