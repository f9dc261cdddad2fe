import base64
import os
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import bpe, canonical, encoding, glyphs, language, ocr, pages, queries
from tests.conftest import SMALL

RANKS = os.path.join(bpe.VOCABULARY, "byte_bpe_50k.tiktoken")
SENTENCES = {
    "en": "The control cabinet may be stored outdoors for no longer than nine months. Oil samples are taken when the filter is replaced. ",
    "de": "Im Freien darf das Gerät höchstens neun Monate stehen und die Dichtung wird geprüft. Der Schaltschrank muss zerlegt werden. ",
    "fr": "Le stockage à l'extérieur ne dépassera pas neuf mois et le joint doit être contrôlé. Les documents sont valables. ",
    "ru": "Шкаф автоматики допускается хранить на открытой площадке не более девяти месяцев. Пробы масла отбирают перед пуском. ",
    "uk": "Шафа автоматики дозволяється зберігати на відкритому майданчику не більше дев'яти місяців. Проби оливи відбирають перед пуском. ",
}


# ---- problem 1


@pytest.fixture(scope="module")
def lists(spark):
    allowed = spark.createDataFrame([(40, "list_material", "Carbon steel"), (41, "list_material", "Stainless steel AISI 304"), (42, "list_material", "Stainless steel AISI 316L"), (10, "uom_length", "mm"), (12, "uom_length", "m")], "item_id int, list_name string, item string")
    props = spark.createDataFrame([(1, "body material", "материал корпуса"), (2, "overall length", None)], "prop_id long, prop_name_eng string, prop_name_rus string")
    valid = spark.createDataFrame([(1, "property_value", "list_material"), (2, "uom", "uom_length")], "prop_id long, target_col string, list_name string")
    return allowed, props, valid


def test_free_entries(spark, lists):
    allowed, props, valid = lists
    entries = ["carbon stele", "Cаrbоn stееl", "steel Carbon", "Carbonsteel", "CS", "Carbon steel (std)", "Stainless stel AISI 304", "316L", "oak timber", "Carbon steel", None, "", "N/A"]
    rows = [(i, "body material", None, e, "x", 0) for i, e in enumerate(entries)] + [(100 + i, "overall length", None, "1", u, 0) for i, u in enumerate(["мм", "MM", "pcs", "mm", None])]
    r = spark.createDataFrame(rows, "row_id long, property_name string, property_name_rus string, property_value string, uom string, item_id int")
    got = {x["row_id"]: (x["target_col"], x["item_id"]) for x in canonical.free_entries(r, props, valid, allowed, canonical.known_names(spark)).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: 40, 1: 40, 2: 40, 3: 40, 4: 40, 5: 40, 6: 41, 7: 42, 8: -1, 100: 10, 101: 10, 102: -1}
    bare = {x["row_id"]: x["item_id"] for x in canonical.free_entries(r, props, valid, allowed).collect()}
    assert {k: v for k, v in bare.items() if k < 100} == {0: 40, 1: 40, 2: 40, 3: 40, 4: -1, 5: 40, 6: 41, 7: -1, 8: -1}
    own = spark.createDataFrame([("Carbon steel", "oak timber")], "item string, form string")
    assert {x["row_id"]: x["item_id"] for x in canonical.free_entries(r, props, valid, allowed, own).collect()}[8] == 40
    assert canonical.free_entries(r.limit(0), props, valid, allowed).count() == 0


def test_similarity_join_is_exact(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), rng.integers(3, 8))) for _ in range(60)]
    df = lambda ws: spark.createDataFrame([("b", w) for w in sorted(set(ws))], "block string, key string").withColumn("tokens", canonical.tokens(F.col("key")))
    left, right = df(words[:30]), df(words[30:])
    sets = lambda d: {r["key"]: set(r["tokens"]) for r in d.collect()}
    want = {(a, b): round(len(x & y) / len(x | y), 9) for a, x in sets(left).items() for b, y in sets(right).items() if len(x & y) >= 0.45 * len(x | y)}
    assert {(r["left_key"], r["right_key"]): round(r["jaccard"], 9) for r in canonical.similar(left, right).collect()} == want


# ---- problem 4


def test_languages(spark):
    page = lambda k, *langs: "".join(SENTENCES[x] for x in langs) + f"\n{k + 1}[!@#$%]EOP{k}[!@#$%]\n"
    rows = [(i, page(0, x, x) + page(1, x), None, x) for i, x in enumerate(list(SENTENCES) * 8)]
    rows += [(900, page(0, "en", "en") + page(1, "en", "ru"), None, "en"), (901, page(0, "de"), None, None), (902, page(0, "fr", "fr"), None, "English"), (903, None, None, "en"), (904, "", None, "en")]
    files = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "file_id long, pure_text string, headers string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, "en")], "file_id long, lang string")
    got = language.page_languages(spark, files, labels)
    assert sorted(map(tuple, language.to_relabel(got).collect())) == [(900, 0, "en"), (900, 1, "en"), (900, 1, "ru"), (901, 0, "de"), (902, 0, "fr")]
    assert all(0 <= r["confidence"] <= 1 for r in got.collect())


def test_confidence_of_segments_that_follow_their_neighbours():
    a, b = language.Svm("ru", "uk"), language.Svm("de", "en")
    judge = language.Discriminator([a, b, language.Svm("de", "fr"), language.Svm("en", "fr")])
    for w, sign in (("слово", 0.05), ("щось", -0.02)):
        a.weights[language.features(w)] += sign
    segs = [language.Segment([("слово", 0)] * 12, "cyrillic"), language.Segment([("щось", 0)] * 2, "cyrillic"), language.Segment([("λόγος", 0)] * 5, "other")]
    judge.assign([segs, []])
    assert [s.lang for s in segs] == ["ru", "ru", "und"]
    assert 0.8 < segs[1].confidence < segs[0].confidence < 1 and segs[2].confidence == 0.0
    assert language.family("λόγος") == "other" and language.family("Gerät") == "latin" and language.family("слово") == "cyrillic"


def test_labels(spark):
    d = spark.createDataFrame([(x,) for x in [" EN", "ru-RU", "ukr", "German", "?", "", None, "und", "fre"]], "v string")
    assert [r[0] for r in d.select(language.label(F.col("v"))).collect()] == ["en", "ru", "uk", "de", None, None, None, None, "fr"]


# ---- problem 6


@pytest.mark.parametrize(
    ("text", "fixed"),
    [("ｍａｎｕａｌ", "manual"), ("пoдтвepждaeт", "подтверждает"), ("te‍st", "test"), ("a b", "a b"), ("изнӧс й", "изнӧс й"), ("1000–РК–0292А", "1000-PK-0292A"), ("persοnnel", "personnel"), ("°C — «да» 5 м³", "°C — «да» 5 м³"), ("", ""), ("plain", "plain"), ("Gerät", "Gerät")],
)
def test_canonical(text, fixed):
    assert glyphs.canonical(text) == fixed
    assert glyphs.canonical(glyphs.canonical(text)) == fixed


UNSTABLE = "aeоаΑνo \n-1\u0301\u0308\u200b\u00a0\u212bａ\u3000ﬁйи\u0306①\u1161\u1100x\u00adΤｶﾞ𝐀"


@given(st.one_of(st.text(max_size=60), st.text(alphabet=UNSTABLE, max_size=16)))
@settings(max_examples=600, deadline=None)
def test_canonical_is_stable(text):
    once = glyphs.canonical(text)
    assert glyphs.canonical(once) == once
    assert not glyphs.HIDDEN.search(once) and not glyphs.BLANK.search(once)
    assert unicodedata.is_normalized("NFC", once)


@given(st.lists(st.text(alphabet=UNSTABLE.replace("\n", ""), max_size=8), max_size=4))
@settings(max_examples=300, deadline=None)
def test_canonical_of_lines_is_that_of_each(lines):
    assert glyphs.canonical("\n".join(lines)).split("\n") == ([glyphs.canonical(x) for x in lines] or [""])


@pytest.mark.parametrize(("text", "fixed"), [("a\u200b \u212b", "a \u00c5"), ("\u212b", "\u00c5"), ("ﬁlter", "filter"), ("ｶﾞ", "ガ"), ("①", "①"), ("5 м² ½", "5 м² ½")])
def test_canonical_by_properties(text, fixed):
    assert glyphs.canonical(text) == fixed


def test_places(spark):
    f = spark.createDataFrame([(1, "1000-РК-0292А,1000-P-0001", "ok[!@#$%]EOP0[!@#$%]\nt​est[!@#$%]EOP1[!@#$%]"), (2, None, None), (3, "", "")], "file_id long, mentioned_tags string, pure_text string")
    assert sorted((r["file_id"], r["field"], r["place"]) for r in glyphs.fixed_places(f).collect()) == [(1, "mentioned_tags", 0), (1, "pure_text", 1)]


# ---- problem 7


def test_pages():
    p = pages.read("QD20000 Ostwerk Anlagen\nfirst line.\n[1][!@#$%]EOP0[!@#$%]\nQD20000 Os'werk Anlagen\nmore text.\nstr[!@#$%]EOP1[!@#$%]", None)
    assert [(x.number, sorted(x.running)) for x in p] == [(0, [0, 2]), (1, [1])]
    assert pages.read(None, None) == [] and pages.heads_of("no json") == []


def test_repairs(spark):
    clean = "Check the mechanical seal and record the reading in the log.\nTorque the bolts in a crosswise order with the warm-up period."
    torn = "Check the mech-\nanical seal and rccord the rea¬\nding in the log. The cros5wise or\nder of the warm-\nup period."
    rows = [(i, clean + "[!@#$%]EOP0[!@#$%]", None) for i in range(12)] + [(50, torn + "\n[1][!@#$%]EOP0[!@#$%]", '[[0, "Chcck log"]]'), (51, None, None), (52, "", "bad")]
    f = spark.createDataFrame(rows, "file_id long, pure_text string, headers string")
    got = sorted((r["place"], r["kind"], r["fixed"]) for r in ocr.repairs(spark, f).filter("file_id = 50 and field = 'pure_text'").collect())
    assert got == sorted([(0, "broken", "mechanical"), (0, "misread", "record"), (0, "broken", "reading"), (0, "misread", "crosswise"), (0, "broken", "order"), (0, "broken", "warm-up"), (0, "running", "[1]")])
    assert [r["fixed"] for r in ocr.repairs(spark, f).filter("field = 'headers'").collect()] == ["Check"]
    text = " ".join(r["text"] for r in ocr.readable(spark, f).filter("file_id = 50").orderBy("par_no").collect())
    assert "mechanical seal and record the reading in the log" in text and "[1]" not in text


WORDS = ocr.Lexicon(dict.fromkeys("the gas filter pressure of pump mechanical seal check record and reading order warm-up under или".split(), 50))


@pytest.mark.parametrize(
    ("text", "read"),
    [
        ("thegasfilter of pump", "the gas filter of pump"), ("pre-\nssu-\nre of", "pressure of"), ("pre ssu re of pump", "pressure of pump"), ("the fil-\ntergas pump", "the filter gas pump"), ("warm-\nup of", "warm-up of"), ("warmup: of", "warmup: of"),
        ("check themechanicalseal, and", "check the mechanical seal, and"), ("rec0rd the rea¬\nding", "record the reading"), ("12-\n34 of", "12-\n34 of"), ("", ""), ("PX-100 of", "PX-100 of"),
    ],
)
def test_stream_decoding(text, read):
    assert ocr.mended(text, WORDS) == read


def test_cutting_the_stream_changes_nothing():
    rng = np.random.default_rng(5)
    words = list(WORDS.n) + ["rccord", "sea1", "xyzzyq", "12"]
    for _ in range(150):
        picked = [str(w) for w in rng.choice(words, 9)]
        text = "".join(w[:2] + ["", "", "-\n", " "][rng.integers(4)] + w[2:] + [" ", " ", "\n", ""][rng.integers(4)] for w in picked)
        tokens, _ = ocr._tokens(text)
        whole = [r[4] for r in ocr.decode(tokens, WORDS)]
        parts, at = [], 0
        for a, b in ocr.regions(tokens, WORDS):
            parts += [t[0] for t in tokens[at:a]] + [r[4] for r in ocr.decode(tokens[a:b], WORDS)]
            at = b
        assert parts + [t[0] for t in tokens[at:]] == whole, text


def test_long_paragraphs():
    lines = ["this is a long line of text that goes on and on"] * 200
    assert len(ocr.paragraphs(lines, set())) == 1
    assert ocr.paragraphs(["Heading", "one line of text that ends here.", "Name: 5 mm", "another"], {"Heading"})[0] == "Heading" and ocr.paragraphs([], set()) == []


# ---- problem 8


@pytest.fixture(scope="module")
def standard():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.CUT, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoder_is_exact(standard, text):
    e = bpe.encoder(RANKS)
    ids = e.encode(text)
    assert ids == standard.encode_ordinary(text)
    assert e.decode(ids) == text


def test_encode_texts(spark, standard):
    long = "long 'text's — текст 12345  \n" * 5000
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, long), (4, "a b")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_texts(d).collect())
    assert got == sorted([(1, standard.encode_ordinary("a b")), (2, []), (3, []), (4, standard.encode_ordinary(long)), (4, standard.encode_ordinary("a b"))])


# ---- problem 10


@pytest.mark.parametrize("shown,written", [("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp866", "utf-8"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1252", "cp1251")])
def test_wrong_encodings(spark, shown, written):
    good = SENTENCES["ru"].strip()
    bad = good.encode(written).decode(shown, "replace")
    rows = [(i, "\n".join(SENTENCES.values())) for i in range(20)] + [(100, f"{good}\n{bad}\nx² + y³ ≈ 5 µm"), (101, None), (102, ""), (103, "Ø 57 × 3 mm\nCHÂTEAU D’EAU – DÉBIT ÉLEVÉ"), (104, "5 Â°C"), (105, "Why? Really??\n?????? ??? 5 ?C")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r["restored"] for r in encoding.find(spark, d).collect()}
    assert set(got) == {(100, 1), (104, 0), (105, 1)}
    assert got[104, 0] == "5 °C"
    if "�" not in bad:
        assert got[100, 1] == good


@pytest.mark.parametrize(("line", "is_lost"), [("Is it open ?? yes", False), ("Why? Really??", False), ("What ???", False), ("?????? ??? 5 ?C", True), ("выполняет ??????? по", True), ("Gr??e aus", True), ("a\ufffdb", True), ("", False)])
def test_lost_letters(line, is_lost):
    assert encoding.lost(line) is is_lost


def test_lost_characters():
    assert encoding.reread("Ð”Ð°", "cp1252", "utf-8") == "Да"
    assert encoding.reread("plain Я", "latin-1", "utf-8") is None


# ---- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "tagloom")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"^\s*(?:from|import) tagloom\.llm", open(os.path.join(folder, n), encoding="utf-8").read(), re.MULTILINE)
