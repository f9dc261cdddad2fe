import difflib
import glob
import itertools
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tagloom.operators import store, units
from tagloom.session import counted
from tagloom.sources import schemas
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(_norm, r)) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert ours == sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


UNCHECKED = {"p2_found", "p2_units", "p3_found", "p3_wide", "p5_found", "proximity_groups", "token_subset_specific", "tag_fuzzy_fix", "register_fill", "run_summary"}


def test_all_queries_are_checked():
    assert {n for n in QUERIES if n not in ORACLES and not n.startswith(("p1_", "p4", "p6", "p7", "p8", "p9", "p10"))} == UNCHECKED


@pytest.fixture(scope="module")
def texts(spark):
    return {r["file_id"]: r["pure_text"] or "" for r in spark.read.parquet(f"{SMALL}/files.parquet").collect()}


def _middles(text, words, width):
    """Middles of the groups that hold all words, taken from the left, by looking at every stretch."""
    places = sorted((m.start(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in words)
    out, first = [], 0
    for last in range(len(places)):
        window = [p for p in places[first : last + 1] if places[last][0] - p[0] < width]
        if {w for _, w in window} == set(words):
            out.append((window[0][0] + places[last][0]) // 2)
            first = last + 1
    return out


def test_proximity_groups(spark, texts):
    got = sorted(map(tuple, QUERIES["proximity_groups"](spark, SMALL).select("file_id", "pos").collect()))
    assert got == sorted((k, p) for k, t in texts.items() for p in _middles(t, ["spare", "parts", "two", "years"], 150))


def test_token_subset_specific(spark, texts):
    words, want = ["design", "pressure", "gas", "filter"], []
    for k, t in texts.items():
        found = [(len(h), n, c) for n in range(1, 5) for c in itertools.combinations(range(4), n) if (h := _middles(t, [words[i] for i in c], 150))]
        if found:
            n, _, c = min(found)
            want.append((k, " ".join(words[i] for i in c), n))
    assert sorted(map(tuple, QUERIES["token_subset_specific"](spark, SMALL).select("file_id", "tokens", "hits").collect())) == sorted(want)


def test_tag_fuzzy_fix(spark):
    tags = sorted({(r["tag"] or "").replace("\ufeff", "").strip() for r in spark.read.parquet(f"{SMALL}/tags.parquet").collect()} - {""})
    rows = QUERIES["tag_fuzzy_fix"](spark, SMALL).select("cleaned", "fixed").distinct().collect()
    for cleaned, fixed in rows:
        scores = [(difflib.SequenceMatcher(None, t, cleaned).ratio(), t) for t in tags]
        assert fixed == (cleaned if cleaned in tags else max([s for s in scores if s[0] >= 0.7], default=(0, cleaned))[1])
    assert rows


def test_register_fill_and_summary(spark):
    before = {r["row_id"]: (r["property_value"], r["uom"]) for r in spark.read.parquet(f"{SMALL}/register.parquet").collect()}
    after = {r["row_id"]: (r["property_value"], r["uom"]) for r in QUERIES["register_fill"](spark, SMALL).collect()}
    changed = {k for k in before if before[k] != after[k]}
    total = QUERIES["run_summary"](spark, SMALL).first()
    assert set(after) == set(before) and total["solved"] + total["failed"] == total["tasks"] <= total["prompts"] + total["failed"]
    assert (len(changed) > 0) == (total["solved"] > 0)


@pytest.mark.parametrize("name", ["p2_found", "p2_units", "p3_found", "p3_wide", "p5_found"])
def test_problems_give_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_p2_found_runs_the_whole_method(spark, monkeypatch):
    """Units that aren't written are judged too; what comes out are the rows of the whole result whose unit is written."""
    judged, predict = [], units.UnitClassifier.predict
    monkeypatch.setattr(units.UnitClassifier, "predict", lambda self, rows: judged.append((self.ready, rows.count())) or predict(self, rows))
    df = QUERIES["p2_found"](spark, SMALL)
    found = {tuple(r) for r in df.collect()}
    assert len(judged) == 1 and judged[0][0] and judged[0][1] > 0
    assert df._jdf.queryExecution().optimizedPlan().toString().count("+- ArrowEvalPython") == 1
    whole = QUERIES["p2_units"](spark, SMALL).collect()
    assert found and found <= {(r["row_id"], r["value_no"], r["base_milli"]) for r in whole if r["unit_from"] in ("uom", "value")}
    assert not {r[0] for r in found} & {r["row_id"] for r in whole if r["unit_from"] == "predicted"} and any(r["unit_from"] == "predicted" for r in whole)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ingest_runs_on(spark, tmp_path):
    from tagloom.streaming import ingest

    folder = tmp_path / "in"
    files = spark.read.parquet(f"{SMALL}/files.parquet")
    files.filter("file_id < 60").write.parquet(str(folder / "a"))
    os.makedirs(folder / "flat")
    for f in glob.glob(str(folder / "a" / "*.parquet")):
        os.rename(f, folder / "flat" / os.path.basename(f))
    for _ in range(2):
        ingest.ingest(spark, str(folder / "flat"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == ingest.mentions(files.filter("file_id < 60")).count()


def test_sources(spark, tmp_path):
    from tagloom.sources import files as src

    p = tmp_path / "tags.txt"
    p.write_text("﻿A-1\nA-1\n\nB-2\n", encoding="utf-8")
    assert sorted(r["tag"] for r in src.read_registry(spark, str(p)).collect()) == ["A-1", "B-2"]
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="lacks"):
        src.read_register(spark, str(tmp_path / "r"))
    xml = "<html><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 90'>ab</span><span class='ocrx_word' title=''>|_;</span></html>"
    got = [tuple(r) for r in src.recognised_words(spark.createDataFrame([(1, xml)], "k long, x string"), "k", "x").collect()]
    assert got == [(1, 0, "ab", 90, 1, 2, 3, 4), (1, 1, "", None, 0, 0, 0, 0)]
    r = spark.createDataFrame([("T-1", "mass", None, "5", "d", "kg")], "`Tag Number` string, `Property Name` string, `Property Name Rus` string, `Property Value` string, `Property Description Rus` string, `UoM` string")
    src.write_register(r, str(tmp_path / "register.csv"))
    back = src.read_register(spark, str(tmp_path / "register.csv"))
    assert [tuple(x) for x in back.select(*src.REGISTER_COLUMNS).collect()] == [("T-1", "mass", None, "5", "d", "kg")]
    src.write_register(back, str(tmp_path / "register"))
    assert src.read_register(spark, str(tmp_path / "register")).count() == 1
    for name, text in (("a.json", '[{"id": "x-1", "names": {"EN": "mass", "RU": "масса"}, "comments": {"EN": "e", "RU": "r"}}]'), ("b.json", '[{"id": "y.ru-2", "names": {"EN": "n", "RU": "н"}}]')):
        (tmp_path / name).write_text(text, encoding="utf-8")
    dumps = src.read_dumps(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert dumps.count() == 2 and [x["external_id"] for x in store.dump_rows(dumps).collect()] == ["x-1"]
    os.makedirs(tmp_path / "docs" / "deep")
    for name in ("one.pdf", "deep/two.pdf"):
        (tmp_path / "docs" / name).write_bytes(b"%PDF")
    known = spark.createDataFrame([("one.pdf",)], "file_name string")
    assert sorted(x["file_name"] for x in src.ingest_folder(spark, str(tmp_path / "docs")).collect()) == ["one.pdf", "two.pdf"]
    assert [(x["file_name"], bytes(x["content"])) for x in src.ingest_folder(spark, str(tmp_path / "docs"), known).collect()] == [("two.pdf", b"%PDF")]
    assert src.read_binary(spark, str(tmp_path / "docs" / "one.pdf")).count() == 1
    p = spark.createDataFrame([(1, 4), (2, None), (3, 1)], "k int, pages int")
    assert sorted((x["k"], x["page"]) for x in src.page_range(p, -2, 1).collect()) == [(1, 0), (1, 1), (3, 0)]
    assert src.page_range(p).count() == 5 and src.page_range(p, 3, 2).count() == 0


def test_conforming_rows(spark):
    kinds = "prop_id long, external_id string, prop_name_eng string, prop_desc_eng string, search_condition string, alt_keywords string, flag int"
    rows = [(2, None, "a", None, None, None, None), (1, "x-1", "a", "d", "none", "k", 1), (3, "x-2", None, "d", "none", "k", 1), (4, "x-3", "b", "d", "other", "k", 1), (5, "x-1", "c", "d", "none", "k", 0)]
    got = sorted(map(tuple, schemas.conforming(spark.createDataFrame(rows, kinds), "properties", "prop_id").collect()))
    assert got == [(1, "x-1", "a", "d", "none", "k", 1)]
    files = spark.createDataFrame([(1, "f", 0, "t", None), (2, "f", 1, "t", None), (3, "f", 2, "u", "A-1"), (4, "g", None, None, None)], "file_id long, file_name string, pages int, pure_text string, mentioned_tags string")
    assert [tuple(r) for r in schemas.conforming(files, "files", "file_id").collect()] == [(2, "f", 1, "t", "")]


def test_counted(spark):
    df, seen = counted(spark.range(7), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7}
