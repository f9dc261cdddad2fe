import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import quantity, text
from tagloom.functions.forest import Forest, isotonic
from tagloom.operators import boxes, cascade, contexts, resolve, search, slicing, store, strategies, tagfix, units, unpack, widen

REGISTER = "row_id long, tag_number string, property_name string, property_name_rus string, property_value string, property_description_rus string, uom string, entered_at timestamp"
PROPERTIES = "prop_id long, prop_name_eng string, prop_name_rus string, value_kind string, alt_keywords string, extra string"
AT = datetime.datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    props = spark.createDataFrame(
        [(1, "design pressure", "расчётное давление", "quantity", None, "x"), (2, "delivery date", "дата поставки", "date", "none", "x"), (3, "spare fitted", "наличие", "flag", 'a;"b; c"', "x"), (4, "serial number", None, "text", "k", "x"), (5, "wall thickness", "толщина стенки", "quantity", "", "x")],
        PROPERTIES,
    )
    lists = spark.createDataFrame([(1, "uom", "uom_pressure"), (5, "uom", "uom_length")], "prop_id long, target_col string, list_name string")
    items = spark.createDataFrame([(1, "uom_pressure", "bar"), (2, "uom_pressure", "kPa"), (3, "uom_pressure", "psi"), (10, "uom_length", "mm"), (13, "uom_length", "in")], "item_id int, list_name string, item string")
    tags = spark.createDataFrame([(1, "﻿10-P-1"), (2, "10-P-1A"), (3, "10-P-1A"), (4, ""), (5, None), (6, "10-P-2")], "line_no long, tag string")
    return props, lists, items, tags


def reg(spark, rows):
    return spark.createDataFrame([(i, *r, AT + datetime.timedelta(hours=i)) for i, r in enumerate(rows, 1)], REGISTER)


@pytest.mark.parametrize(
    ("value", "low", "high", "unit"),
    [
        ("9 999,5 mm", 9999.5, None, "mm"), ("1'138", 1138.0, None, ""), ("6.796,9", 6796.9, None, ""), ("91,510.7", 91510.7, None, ""), ("1/2", 0.5, None, ""), ("2 1/2 in", 2.5, None, "in"), ("9-1/2", 9.5, None, ""),
        ("minus 3,5 °C", -3.5, None, "°C"), ("≤ 5", 5.0, None, ""), ("не более 7 бар", 7.0, None, "бар"), ("от 1 до 2,5", 1.0, 2.5, ""), ("-5…−3", -5.0, -3.0, ""), ("10 ÷ 20kPa", 10.0, 20.0, "kPa"), ("1.86E2", 186.0, None, ""),
        ("see note 9", None, None, None), ("2019-10-18", None, None, None), ("", None, None, None), (None, None, None, None), ("ambient", None, None, None),
    ],
)
def test_quantity(spark, value, low, high, unit):
    q = spark.createDataFrame([(value,)], "v string").select(quantity.quantity(F.col("v")).alias("q")).first()["q"]
    assert (q and q["low"], q and q["high"]) == (low, high)
    assert low is None or q["unit"] == unit


def test_dates_flags_missing(spark):
    d = spark.createDataFrame([(x,) for x in ["2019-10-18", "11.12.2014", "2013/01/09", "9 June 2020", "9 мая 2020 г.", "31.02.2020", "May 2020", None]], "v string")
    assert [r[0] and str(r[0]) for r in d.select(quantity.full_date(F.col("v"))).collect()] == ["2019-10-18", "2014-12-11", "2013-01-09", "2020-06-09", "2020-05-09", None, None, None]
    f = spark.createDataFrame([(x,) for x in ["YES", " да ", "0", "N", "maybe", ""]], "v string")
    assert [r[0] for r in f.select(quantity.flag(F.col("v"))).collect()] == [True, True, False, False, None, None]
    m = spark.createDataFrame([(x,) for x in [None, "", "  ", "—", "--", "N/A", "Н/Д", "NOANS", "{}", "tbd", "hold", "уточняется", "none", "0", "a"]], "v string")
    assert [r[0] for r in m.select(text.is_missing(F.col("v"))).collect()] == [True] * 13 + [False] * 2


def test_base_milli(spark):
    d = spark.createDataFrame([(123.45, 0.01, 0.0), (98.6, 5 / 9, -32.0), (0.0005, 1.0, 0.0), (0.0015, 1.0, 0.0)], "v double, f double, b double")
    assert [r[0] for r in d.select(quantity.base_milli(F.col("v"), F.col("f"), F.col("b"))).collect()] == [1234, 37000, 0, 2]


def test_tags_and_names(spark, world):
    t = spark.createDataFrame([(x,) for x in ["e-10-p-1a", " 10 - Р - 1А​", "10_P_1A", "10–P–1A"]], "v string")
    assert {r[0] for r in t.select(text.tag_key(F.col("v"))).collect()} == {"10-P-1A"}
    r = reg(spark, [("10-P-1", n, m, "1", None, None) for n, m in [("Design Pressure (rev. 2)", None), ("desgin pressure", None), (None, "РАСЧЕТНОЕ ДАВЛЕНИЕ"), ("wall_thickness", None), ("serial numbr", None), ("quite another", None), (None, None)]])
    got = {x["row_id"]: x["prop_id"] for x in resolve.with_property(r, world[0], ["row_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 5, 5: 4}
    assert sorted(x["tag_number"] for x in resolve.registry(world[3]).collect()) == ["10-P-1", "10-P-1A", "10-P-2"]


def test_common_units(spark, world):
    r = reg(
        spark,
        [("10-P-1", "design pressure", None, v, None, u) for v, u in [("250", "кПа"), ("1 – 2 kPa", None), ("3", "bar"), ("3", "pcs"), ("3 pcs", None), ("7", None), ("see note 1", "kPa"), (None, "kPa")]]
        + [("10-P-1", "wall thickness", None, "1/2", None, "in"), (None, None, None, "1", None, "mm")],
    )
    props, lists, items, _ = world
    got = units.common_units(spark, r.withColumn("extra", F.lit(1)), props, lists, items)
    assert sorted(map(tuple, units.converted(got, items).collect())) == [(1, 1, 2500), (2, 1, 10), (2, 2, 20), (9, 1, 12700)]
    left = {x["row_id"]: (x["unit_from"], x["review"]) for x in got.collect()}
    assert left[4] == ("unknown", True) and left[6][1] and left[3] == ("uom", False)
    empty = units.common_units(spark, r.limit(0), props, lists, items)
    assert empty.count() == 0


def test_forest_and_isotonic():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)
    f = Forest().fit(x[:1500], y[:1500], 4)
    assert (f.predict(x[1500:]).argmax(1) == y[1500:]).mean() > 0.9
    shares = isotonic(np.array([1, 0, 5]), np.array([2, 4, 5]))
    assert shares == sorted(shares) and shares[-1] == 1


def test_wide_table(spark, world):
    props, _, _, tags = world
    r = reg(
        spark,
        [("10-P-1", "design pressure", None, "5 bar", None, None), ("e-10-p-1", "design pressure", None, "7", None, None), ("10-P-1", "design pressure", None, "see note", None, None), ("10-P-1A", "delivery date", None, "01.02.2020", None, None),
         ("10-P-1A", "spare fitted", None, "да", None, None), ("10-P-1A", "serial number", None, "see page 3", None, None), (None, "serial number", None, "x", None, None), ("10-P-9", "serial number", None, "x", None, None)],
    )
    wide = widen.wide_table(spark, r, props, tags)
    by = {x["tag_number"]: x for x in wide.collect()}
    assert set(by) == {"10-P-1", "10-P-1A", "10-P-2"}
    assert by["10-P-1"]["p001_design_pressure"]["low"] == 7.0
    assert by["10-P-1A"]["p002_delivery_date"] == datetime.date(2020, 2, 1) and by["10-P-1A"]["p003_spare_fitted"] is True
    assert sorted(map(tuple, widen.filled(wide, props).collect())) == [("10-P-1", 1), ("10-P-1A", 2), ("10-P-1A", 3), ("10-P-1A", 4)]
    assert widen.filled(widen.wide_table(spark, r.limit(0), props, tags), props).count() == 0


cells = st.lists(st.tuples(st.integers(0, 4), st.tuples(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.text(max_size=2))), min_size=1, max_size=12)


@given(cells, st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_slot_registers_merge_in_any_order(values, cut):
    whole = widen._start(values[0])
    for v in values[1:]:
        widen._add(whole, v)
    parts = [p for p in (values[:cut], values[cut:]) if p]
    regs = []
    for p in parts:
        r = widen._start(p[0])
        for v in p[1:]:
            widen._add(r, v)
        regs.append(r)
    merged = regs[0] if len(regs) == 1 else widen._merge(regs[0], regs[1])
    assert {k: v[0] for k, v in merged.items()} == {k: v[0] for k, v in whole.items()}


@pytest.mark.parametrize(
    ("packed", "spaces", "values"),
    [
        ('trip level ; "flow, rated",max. allowable ; ', False, ["trip level", "flow, rated", "max. allowable"]), ('"2"" nozzle" | x', False, ['2" nozzle', "x"]), ('["a", "2\\" b"]', False, ["a", '2" b']), ("'a;b' / c/d / ", False, ["a;b", "c/d"]),
        ("a,,b,", False, ["a", "b"]), ("vendor's figure;b", False, ["vendor's figure", "b"]), ("A-1 \"B-2\"\tC-3", True, ["A-1", "B-2", "C-3"]), ("A-1，B-2; A-1", True, ["A-1", "B-2", "A-1"]), ("  ", False, []), ("  A-1", True, ["A-1"]),
    ],
)
def test_unpack(spark, packed, spaces, values):
    df = spark.createDataFrame([(1, packed, 9)], "k long, f string, pos int")
    got = unpack.values_of(df, "k", "f", spaces).orderBy("pos").collect()
    assert [r["item"] for r in got] == values and [r["pos"] for r in got] == list(range(len(values)))


def test_unpack_nulls_and_singles(spark, world):
    files = spark.createDataFrame([(1, None), (2, ""), (3, "A-1"), (4, "A-1,A-1")], "file_id long, mentioned_tags string")
    got = sorted(map(tuple, unpack.several(unpack.unpack(files, world[0])).collect()))
    assert got == [("alt_keywords", 3, 0, "a"), ("alt_keywords", 3, 1, "b; c"), ("mentioned_tags", 4, 0, "A-1"), ("mentioned_tags", 4, 1, "A-1")]


def test_literal_hits(spark):
    d = spark.createDataFrame([(1, "aaaa"), (2, "ABabAb"), (3, ""), (4, None), (5, "x")], "k long, t string")
    assert sorted(map(tuple, search.literal_hits(d, "k", "t", "aa").collect())) == [(1, 0), (1, 1), (1, 2)]
    assert sorted(map(tuple, search.literal_hits(d, "k", "t", "ab").collect())) == [(2, 0), (2, 2), (2, 4)]
    assert search.literal_hits(d, "k", "t", "").count() == 0
    long = spark.createDataFrame([(1, "ab-" * 5000)], "k long, t string")
    got = sorted(r["pos"] for r in search.literal_hits(long, "k", "t", "b-").collect())
    assert got == [3 * i + 1 for i in range(5000)]


@given(st.text("abс ", max_size=40), st.sampled_from(["ab", "b", "aс", "bb"]))
@settings(max_examples=30, deadline=None)
def test_proximity_against_definition(text_, needle):
    places = [i for i in range(len(text_)) if text_.startswith(needle, i)]
    assert search.proximity([places], 150) == places


def test_proximity_and_subsets():
    assert search.proximity([[10, 500, 910], [20, 900]], 150) == [15, 905]
    assert search.proximity([[0], [150]], 150) == []
    assert search.phrase_hits("The Design of the pressure", "design pressure") == [(4 + 18) // 2]
    assert search.most_specific("gas gas filter gas", "gas filter") == (["filter"], [8])
    assert search.most_specific(None, "x") is None and search.phrase_hits("x", None) == []
    many = " ".join(f"word{chr(97 + i)}" for i in range(14))
    apart = "pump " * 50
    assert search.most_specific(f"{many} {apart} " * 2, many + " absent") == (["worda"], search.most_specific(f"{many} {apart} " * 2, "worda")[1])
    assert search.most_specific("gas filter gas" + apart + "gas", "gas filter", fixed=["gas"])[0] == ["gas", "filter"] and search.most_specific("gas", "gas filter", fixed=["oil"]) is None
    stems = lambda t: [(w[:4].lower(), 0) for w in t.split()]
    assert search.phrase_hits("filters", "filtering", stems) == [0]


@given(st.lists(st.sampled_from("ab cd ef gh".split()), max_size=30), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_most_specific_against_all_subsets(words, gap):
    from itertools import combinations

    text = (" " * gap).join(words)
    want = None
    for n in range(1, 5):
        for c in combinations("ab cd ef gh".split(), n):
            places = search.token_places(text)
            hits = search.proximity([places[w] for w in c], 150) if all(w in places for w in c) else []
            if hits and (want is None or len(hits) < len(want[1])):
                want = (list(c), hits)
    assert search.most_specific(text, "ab cd ef gh") == want


def test_cells_with():
    cells = [(1, 0, "name", "pump"), (1, 1, "rated power, kW", "5"), (2, 0, "name", "rated fan"), (2, 1, "rated power, kW", "-")]
    assert search.cells_with(cells, "rated power", "fan", "absent", None) == [[(1, 1)], [(2, 0)], [], []]
    assert search.cells_with([], "x") == [[]] and search.cells_with([(0, 0, None, None)], "x") == [[]]


def test_homoglyphs_and_tags(spark):
    d = spark.createDataFrame([("HOPE",), ("hope",), ("tag",), ("cтoль",)], "v string")
    assert [r[0] for r in d.select(search.mend_looks(F.col("v"))).collect()] == ["НОРЕ", "hоре", "tag", "столь"]
    t = spark.createDataFrame([(1, "E-71-V-2002A; 555-3824; BY-NC; AGCC-1-2")], "k long, t string")
    assert [r["tag"] for r in slicing.tags_by_text(t, "k", "t").collect()] == ["71-V-2002A"]
    reg_ = spark.createDataFrame([("7230-HV-0011",), ("72-P-4001A",)], "tag_number string")
    f = tagfix.corrected(spark, tagfix.candidates(spark.createDataFrame([(1, "see 723O-HV-0011 and 72 - Р - 4001A")], "k long, t string"), "k", "t"), reg_)
    assert sorted(r["fixed"] for r in f.collect()) == ["72-P-4001A", "7230-HV-0011"]
    whole = spark.createDataFrame([(1, "see 723O-HV-0011 and 72 - Р - 4001A"), (2, None)], "k long, t string")
    assert {r["k"]: r["text"] for r in tagfix.repaired(whole, "k", "t", f).collect()} == {1: "see 7230-HV-0011 and 72-P-4001A", 2: None}


def test_nearest_tag_against_all():
    import difflib

    rng = __import__("random").Random(4)
    tags = sorted({f"{rng.randint(1000, 1009)}-{rng.choice(['HV', 'PK', 'SS-18-T-SJ'])}-{rng.randint(0, 999):04d}{rng.choice(['', 'A', 'B'])}" for _ in range(400)})
    known = tagfix.Registry(tags)
    for t in rng.sample(tags, 60):
        w = "".join(rng.choice("OSIB") if rng.random() < 0.25 else c for c in t)
        scores = [(difflib.SequenceMatcher(None, x, w).ratio(), x) for x in tags]
        want = max((s for s in scores if s[0] >= tagfix.CUTOFF), default=None)
        assert known.nearest(w) == want, w


def test_slices():
    assert slicing.cut_slices([(0, 500), (100, 500), (600, 650), (700, None), (900, None)], 2000) == [(0, 500), (700, 2000)]
    assert slicing.cut_slices([(0, 500), (300, 800), (800, 900)], 2000) == [(0, 500), (500, 800)]
    assert slicing.cut_slices([(0, 120)], 2000) == [] and slicing.cut_slices([], 10) == []


def test_slices_of_the_registry(spark):
    text = "A-1 " + "x" * 150 + " B-2 " + "y" * 150 + " C-3 end A-1 " + "z" * 200
    d = spark.createDataFrame([(1, text), (2, None)], "file_id long, pure_text string")
    reg_ = spark.createDataFrame([("A-1",), ("C-3",)], "tag string")
    at = text.index("C-3")
    got = sorted(map(tuple, slicing.tag_slices(d, "file_id", "pure_text", reg_).collect()))
    assert got == [(1, "A-1", 0, 0, at), (1, "A-1", 1, text.rindex("A-1"), len(text))]
    cut = {r["tag"]: r["text"] for r in slicing.slice_texts(d, slicing.tag_slices(d, "file_id", "pure_text", reg_), "file_id", "pure_text").collect()}
    assert cut["A-1"].startswith(text[:at] + f"(!@#$)EOF;0;{at};(!@#$)\n") and cut["A-1"].count("EOF") == 2


def test_tables_put_back(spark):
    mark = "[!@#$%]EOP{}[!@#$%]"
    text = f"abc def{mark.format(0)}abc ghi{mark.format(1)}jkl"
    anchors = [(1, 1, "nope", [], []), (1, 0, "abc", ["P-9"], ["T-1"]), (0, 0, "", [], ["A", "B"]), (2, 5, "abc", None, None)]
    d = spark.createDataFrame([(1, text, anchors), (2, None, None)], "file_id long, text string, anchors array<struct<page:int,table_idx:int,before:string,passport_tags:array<string>,tags:array<string>>>")
    r = {x["file_id"]: x for x in slicing.insert_tables(d).collect()}
    zero, one = mark.format(0), mark.format(1)
    assert r[1]["text"] == f"A;Babc def{zero}abcP-9T-1 ghi{one}jkl"
    assert r[1]["indexes"] == [3, len(f"A;Babc def{zero}abcP-9T-1"), len(f"A;Babc def{zero}"), len(f"A;Babc def{zero}abcP-9T-1 ghi{one}")]
    assert (r[2]["text"], r[2]["indexes"]) == ("", [])


def test_headings_found_on_their_page(spark):
    mark = "[!@#$%]EOP{}[!@#$%]"
    text = f"1 GENERAL DATA\nsee 2 STORAGE{mark.format(0)}\n2 STORAGE\n3.1 Other{mark.format(1)}"
    heads = [(0, "1 GENERAL DATA"), (1, "2 STORAGE of parts"), (1, "3.1 Other"), (1, "9 MISSING"), (1, "nowhere")]
    d = spark.createDataFrame([(1, text, heads)], "file_id long, pure_text string, heads array<struct<page:int,text:string>>")
    got = {r["ord"]: r["pos"] for r in slicing.anchored(d).collect()}
    assert got == {0: text.index("GENERAL"), 1: text.rindex("STORAGE"), 2: text.index("3.1 Other")}


def test_bold_headings_and_pages(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, "1.2", True), (1, 0, 0, 1, "  Scope ", False), (1, 0, 1, 0, "2 Plain", False), (1, 1, 0, 0, "no number", True), (1, 1, 1, 0, None, True)], "file_id long, page int, block int, ord int, text string, is_bold boolean")
    assert [tuple(r) for r in slicing.bold_headings(spans).collect()] == [(1, 0, 0, "1.2 Scope")]
    p = spark.createDataFrame([(1, 1, "b  c\n\n"), (1, 0, "a"), (2, 0, None)], "file_id long, page int, text string")
    assert {r["file_id"]: r["text"] for r in slicing.assembled(p).collect()} == {1: "a[!@#$%]EOP0[!@#$%]\nb c\n[!@#$%]EOP1[!@#$%]", 2: "[!@#$%]EOP0[!@#$%]"}
    sheets = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "file_id long, phys_page int")
    assert sorted(map(tuple, boxes.logical_pages(sheets, "file_id", sheets.filter("phys_page = 1")).collect())) == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 0, 3)]


def test_chunks():
    assert contexts.cut_chunks("ab cd", 100) == [(0, 5)] and contexts.cut_chunks("", 5) == [(0, 0)]
    assert contexts.cut_chunks("aaa bbb\nccc ddd", 10) == [(0, 7), (8, 3), (12, 3)]
    assert contexts.cut_chunks("x" * 25, 10) == [(0, 10), (10, 10), (20, 5)]
    assert contexts.cut_chunks("aaa bbb   \n  ", 8) == [(0, 7)]


def test_technical_sections_by_text(spark):
    body = "1 GENERAL\ntechnical data ... 2\nText.\n2. Technical data\nMass: 5 kg\n" + "w " * 30 + "\n3 STORAGE\nrest"
    d = spark.createDataFrame([(1, body), (2, "nothing here"), (3, None), (4, "technical data without an end")], "file_id long, pure_text string")
    heads = spark.createDataFrame([], "file_id long, ord int, pos long, heading string")
    at = body.index("Technical data")
    cells = [(0, 0, "a", "Mass"), (0, 1, "b", "5")]
    tables = spark.createDataFrame([(1, 7, at + 3, cells)], "file_id long, table_idx int, index long, cells " + search.CELLS)
    got = [tuple(r) for r in contexts.technical_texts(d, heads, tables).collect()]
    end = body.index("3 STORAGE")
    assert got == [(1, at, end, body[at:end] + "\n\nТаблица:<table><tr><td>Mass</td><td>5</td></tr></table>")]
    far = tables.withColumn("index", F.lit(at + 2000).cast("long"))
    assert contexts.technical_texts(d, heads, far).first()["text"] == body[at:end]


def test_boxes(spark):
    assert boxes.SHRINK == 17 and boxes.SHADOW == 8 and boxes.HOLD == 17
    assert boxes.keep_first([(1, 0, 0, 0, 100, 100), (2, 0, 0, 0, 100, 99), (3, 0, 200, 0, 300, 100)]) == [1, 3]
    shadow = (1, 0, 0, 0, 200, 200), (2, 1, 17, 17, 183, 183), (3, 2, 34, 34, 166, 166), (4, 1, 34, 34, 166, 166), (5, 0, 17, 17, 183, 183)
    assert boxes.keep_first(list(shadow)) == [1, 4, 5]
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0), (1, 2, 0, 0, 10, 5, 0), (1, 3, 10, 0, 20, 10, 0)], "p long, box_id long, x1 int, y1 int, x2 int, y2 int, depth int")
    assert sorted(map(tuple, boxes.overlaps(b, ["p"]).collect())) == [(1, 1, 2, 0.5)]
    w = spark.createDataFrame([(1, 1, 0, 0, 1000, 1000, 0), (1, 2, 17, 17, 983, 983, 1), (2, 1, 0, 0, 1000, 1000, 0), (2, 2, 100, 100, 900, 500, 1)], "p long, box_id long, x1 int, y1 int, x2 int, y2 int, depth int")
    assert sorted((r["p"], r["box_id"]) for r in boxes.table_boxes(w, ["p"]).collect()) == [(1, 1), (2, 2)]
    w = spark.createDataFrame([(1, 0, "a", 8, 8, 12, 12), (1, 1, "b", 20, 20, 24, 24)], "p long, ord long, value string, x1 int, y1 int, x2 int, y2 int")
    x = spark.createDataFrame([(1, 1, 0, 0, 10, 10)], "p long, box_id long, bx1 int, by1 int, bx2 int, by2 int")
    assert [r["value"] for r in boxes.words_outside(w, x, ["p"]).collect()] == ["b"]
    assert boxes.words_in(w, (0, 0, 11, 30), ["p"]).count() == 0


def test_bands_and_double_pages(spark):
    rows = spark.createDataFrame([(1, y) for y in (100, 150, 400, 990)] + [(2, 5)], "p long, y int")
    pages = spark.createDataFrame([(1, 1000), (2, 800), (3, 700)], "p long, height int")
    got = sorted(map(tuple, boxes.bands(rows, pages, ["p"]).collect()))
    assert got == [(1, 0, 62, 190), (1, 1, 362, 440), (1, 2, 952, 1000), (2, 0, 0, 800), (3, 0, 0, 700)]
    frame = lambda p, x1, x2, y2=950, c=None: (p, x1, 0, x2, y2, 1000, 1000, c or (x2 - x1) * y2)
    f = spark.createDataFrame([frame(1, 10, 480), frame(1, 510, 980), frame(1, 0, 100), frame(2, 10, 480), frame(2, 10, 480), frame(3, 10, 480), frame(3, 470, 980, 700), frame(4, 10, 480), frame(4, 440, 980), frame(5, 10, 480), frame(5, 510, 980, 950, 200000)], "p long, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int, contour int")
    assert [r["p"] for r in boxes.double_pages(f, ["p"]).collect()] == [1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, k string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 7), ("d", 1), ("c", 1), (None, 3)], "k string, v int")
    assert sorted(map(tuple, store.upsert(old, new, "k", "id", ["v"]).collect())) == [(1, "a", 1), (2, "b", 7), (3, "c", 1), (4, "d", 1)]
    assert tuple(store.upsert_counts(old, new, "k").first()) == (2, 1)
    stamped = store.upsert(old.withColumn("at", F.lit(AT)), new, "k", "id", ["v"], "at").collect()
    assert {r["k"]: r["at"] == AT for r in stamped} == {"a": True, "b": False, "c": False, "d": False}
    assert sorted(map(tuple, store.upsert(old.limit(0), new, "k", "id", ["v"]).collect())) == [(1, "b", 7), (2, "c", 1), (3, "d", 1)]


def test_cascade(spark):
    d = spark.createDataFrame([(x,) for x in ["N/A", "NOANS", "xNOANS", "```json", "80", None]], "v string")
    assert [r[0] for r in d.select(cascade.is_valid(F.col("v"))).collect()] == [False, False, False, False, True, False]
    t = spark.createDataFrame([(1, "dry mass", None, "", None), (2, "length", None, "", None)], "row_id long, name string, values string, hint string, possible array<string>")
    weak = spark.createDataFrame([(1, "dry mass: 5 kg"), (2, "length: 7 mm")], "row_id long, context string")
    strong = spark.createDataFrame([(1, "Dry mass: 6 kg.")], "row_id long, context string")
    got = cascade.solve(t, [("weak", 0.3, weak), ("strong", 0.8, strong)], cascade.RuleExtractor())
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, "6", "kg", "strong"), (2, "7", "mm", "weak")]
    tried = cascade.attempts(t, [("weak", 0.3, weak), ("strong", 0.8, strong)], cascade.RuleExtractor())
    assert sorted((r["row_id"], r["strategy"], r["valid"]) for r in tried.collect()) == [(1, "strong", True), (2, "weak", True)]
    more = t.unionByName(t.limit(1).withColumn("row_id", F.lit(9).cast("long")))
    assert tuple(cascade.summary(more, tried).first()) == (3, 2, 1, 2)
    b = spark.createDataFrame([(1, "x" * 9999), (2, "x" * 10000), (3, "x" * 100001), (4, None)], "k long, t string")
    assert sorted(tuple(r) for r in cascade.batches(b, "k", "t").collect()) == [(1, 0, 0, 9999), (2, 0, 0, 10000)]


def test_each_prompt_is_asked_once_until_one_answers(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Counting(cascade.RuleExtractor):
        def __call__(self, prompts):
            with open(log, "a", encoding="utf-8") as f:
                f.writelines(p.replace("\n", " | ") + "\n" for p in prompts)
            return super().__call__(prompts)

    t = spark.createDataFrame([(1, "dry mass", None, "", None, "kg|t", False), (2, "spare fitted", None, "", None, None, True)], "row_id long, name string, values string, hint string, possible array<string>, units string, mentioned boolean")
    c = spark.createDataFrame([(1, "no dry mass given", 1, "a"), (1, "dry mass: 4 kg", 2, "a"), (1, "dry mass: 5 kg", 3, "b"), (2, "nothing", 1, "a"), (2, "a spare fitted here", 1, "b")], "row_id long, context string, ord int, tier string")
    tiers = [(name, conf, c.filter(F.col("tier") == name).drop("tier")) for name, conf in (("b", 0.3), ("a", 0.8))]
    got = sorted(tuple(r) for r in cascade.solve(t, tiers, Counting()).select("row_id", "value", "uom", "strategy").collect())
    asked = open(log, encoding="utf-8").read().splitlines()
    assert got == [(1, "4", "kg", "a"), (2, "yes", "", "b")]
    assert len(asked) == len(set(asked)) == 4 and sum("Unit, one of: kg|t" in x for x in asked) == 2 and not any("5 kg" in x for x in asked)


def test_replies_read_alike_on_both_sides(spark):
    replies = ['{"value": "80", "uom": "dBA"}', '```json\n{"value": "1", "uom": null}\n```', '{"value": "N/A", "uom": "x"}', "NOANS", "no json", '{"value": ', '{"value": "NOANS x", "uom": "y"}', '{"uom": "m"}', "", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", cascade.parse_reply(F.col("r")).alias("p"))
    ours = {r["i"]: (r["p"]["value"], r["p"]["uom"]) for r in d.filter(cascade.is_valid(F.col("p.value"))).collect()}
    assert ours == {i: x for i, r in enumerate(replies) if (x := cascade.reply_of(r, None, False))}
    assert cascade.reply_of('{"value": "80", "uom": "m"}', ["81"], False) is None and cascade.reply_of("да", None, True) == ("yes", "")


def test_http_extractor():
    import http.server
    import json
    import threading

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ok = body["options"] == {"temperature": 0, "seed": 420} and body["model"] == "m" and body["stream"] is False
            self.send_response(200 if "bad" not in body["prompt"] else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"response": json.dumps({"value": body["prompt"], "uom": "kg"}) if ok else "?"}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = cascade.HttpExtractor(f"http://127.0.0.1:{server.server_port}/", "m", timeout=5)
    assert ask(["one", "bad"]) == ['{"value": "one", "uom": "kg"}', "NOANS"]
    server.shutdown()
    assert cascade.HttpExtractor("http://127.0.0.1:9/", "m", timeout=1)(["x"]) == ["NOANS"]


def test_every_tier_of_the_cascade(spark):
    pad = "word " * 40
    text = f"A-1 Rated Power: 5 kW {pad} B-2 {pad} масса сухая: 7 кг {pad}"
    files = spark.createDataFrame([(1, text)], "file_id long, pure_text string")
    heads = spark.createDataFrame([(1, 0, 0, "Scope"), (1, 1, 9, "1 TECHNICAL DATA"), (1, 2, text.index("B-2"), "2 END")], "file_id long, ord int, pos long, heading string")
    cells = [(0, 0, "item", "Vendor"), (0, 1, "value", "Ostwerk"), (1, 0, "item", "Location"), (1, 1, "value", "north"), (2, 0, "item", "dry mass: 9"), (2, 1, "value", "kg")]
    tables = spark.createDataFrame([(1, 0, 20, None, cells), (1, 1, 5000, ["B-2"], [(0, 0, "a", "design pressure: 3 bar")])], "file_id long, table_idx int, index long, tags array<string>, cells " + search.CELLS)
    registry_ = spark.createDataFrame([("A-1",), ("B-2",)], "tag string")
    row = lambda i, tag, en, ru, condition="none": (i, 1, tag, en, ru, condition, None, None, "", None, "")
    tasks = spark.createDataFrame(
        [row(1, "A-1", "rated power", ""), row(2, "B-2", "", "масса сухая"), row(3, "A-1", "dry mass", "", "search_in_header"), row(4, "B-2", "design pressure", ""), row(5, "A-1", "nowhere", ""), row(6, "A-1", "nothing", "", "only_if_mentioned"), row(7, "A-1", "rated powers", "")],
        "row_id long, file_id long, tag string, name_en string, name_ru string, condition string, values string, units string, hint string, possible array<string>, kind string",
    )
    m = strategies.preload(files, heads, tables, registry_, tasks)
    assert sorted((r["tag"], r["table_idx"]) for r in m.tables.select("tag", "table_idx").collect()) == [("A-1", 0), ("B-2", 1)]
    assert {(r["tag"], r["table_idx"]) for r in m.passports.collect()} == {("A-1", 0), ("B-2", 0)}
    words = spark.createDataFrame([(5, 0, "absent"), (5, 1, "Rated Power")], "row_id long, keyword_no int, keyword string")
    got = {r["row_id"]: (r["value"], r["uom"], r["strategy"]) for r in strategies.solve_register(tasks, m, cascade.RuleExtractor(), words).filter("valid").collect()}
    assert got[1] == ("5", "kW", "simple_en") and got[2] == ("7", "кг", "simple_ru") and got[3][0::2] == ("9", "header") and got[4] == ("3", "bar", "table_en") and got[5] == ("5", "kW", "simple_en")
    assert 6 not in got and set(strategies.STRATEGIES) == set(cascade.CONFIDENCE)
    tried = strategies.solve_register(tasks, m, cascade.RuleExtractor(), words)
    assert "tech_specs" in {r["strategy"] for r in tried.filter("row_id = 6").collect()}


def test_passport_tags(spark):
    reg_ = spark.createDataFrame([("A-1",), ("A-12",), ("Z 9",), ("B",)], "tag string")
    t = spark.createDataFrame([(1, 0, [(0, 0, "x", "Паспорт xA-12y"), (0, 1, "x", "Z"), (0, 2, "x", "9")]), (1, 1, [(0, 0, "x", "A-1")])], "file_id long, table_idx int, cells " + search.CELLS)
    assert sorted(r["tag"] for r in strategies.passport_tags(t, reg_).collect()) == ["A-1", "A-12", "Z 9"]


def test_literal_slices_of_mended_tags(spark):
    text = "НОРЕ-1 " + "x" * 200
    m = strategies.preload(
        spark.createDataFrame([(1, text)], "file_id long, pure_text string"), spark.createDataFrame([], "file_id long, ord int, pos long, heading string"),
        spark.createDataFrame([], "file_id long, table_idx int, index long, tags array<string>, cells " + search.CELLS), spark.createDataFrame([("HOPE-1",)], "tag string"), spark.createDataFrame([(1, "HOPE-1")], "file_id long, tag string"),
    )
    assert [tuple(r) for r in m.slices.collect()] == [(1, "HOPE-1", 0, 0, len(text))]


def test_units_from_neighbours_beat_the_commonest(spark):
    """Units hidden on a third of the rows of the small test table: accuracy, and what is said with confidence."""
    from tests.conftest import SMALL

    t = [spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{n}.parquet") for n in ("register", "properties", "validations", "allowed_items")]
    rows = units.measured(spark, *t).filter("item_id is not null").cache()
    table = quantity.unit_table(spark, t[3]).groupBy("list_name", "item_id").agg(F.first("factor").alias("f"), F.first("before").alias("b")).collect()
    factors = {}
    for r in sorted(map(tuple, table)):
        factors.setdefault(r[0], []).append(r[1:])
    model = units.UnitClassifier(rows.filter("row_id % 3 != 0"), factors)
    hidden = rows.filter("row_id % 3 = 0").toPandas()
    seen = rows.filter("row_id % 3 != 0").toPandas()
    common = seen.groupby("list_name").item_id.agg(lambda x: x.value_counts().index[0])
    said = model.judge(hidden)
    right = said.item_id.to_numpy() == hidden.item_id.to_numpy()
    sure = said.confidence >= 0.9
    base = (hidden.list_name.map(common).to_numpy() == hidden.item_id.to_numpy()).mean()
    print("units:", len(hidden), "right", right.mean(), "commonest", base, "sure", sure.mean(), "right of these", right[sure].mean())
    assert right.mean() > base + 0.1 and right[sure].mean() > 0.9 and sure.mean() > 0.1
    rows.unpersist()


def test_clashing_columns_and_empty_tables(spark, world):
    props, lists, items, tags = world
    r = reg(spark, [("10-P-1", "design pressure", None, "250", None, "кПа"), (None, None, None, None, None, None), ("10-P-1", "design pressure", None, "250", None, "кПа")])
    for c in ("prop_id", "list_name", "item_id", "unit_key", "q", "low", "unit_from", "value_no", "tag_key", "rank", "text", "key", "value_kind", "confidence"):
        r = r.withColumn(c, F.lit(7))
    p = props.withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).withColumn("list_name", F.lit("z"))
    assert sorted(map(tuple, units.converted(units.common_units(spark, r, p, lists, items), items).collect())) == [(1, 1, 2500), (3, 1, 2500)]
    assert widen.filled(widen.wide_table(spark, r, p, tags), p).count() == 1
    assert widen.filled(widen.wide_table(spark, r, p.limit(0), tags), p.limit(0)).count() == 0
    files = spark.createDataFrame([(1, "A-1 B-2", 3, 4, "x")], "file_id long, mentioned_tags string, pos int, item int, rec_id string")
    assert unpack.unpack(files, p.withColumn("rec_id", F.lit(1))).filter("field = 'mentioned_tags'").count() == 2
    assert unpack.unpack(files.limit(0), p.limit(0)).count() == 0
    assert units.converted(units.common_units(spark, r, p, lists.limit(0), items.limit(0)), items.limit(0)).count() == 0
