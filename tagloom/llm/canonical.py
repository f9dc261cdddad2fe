"""Freely typed entries mapped to the items of their reference list by a set-similarity join (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.quantity import UNIT_SPELLINGS, unit_key
from tagloom.functions.text import INVISIBLE, is_missing, latin_looks, squeeze
from tagloom.operators.resolve import with_property
from tagloom.session import broadcast_if_small, cut

# --- fixed values: names by which the items are also known -----------------------------------------
KNOWN_AS = {
    "Carbon steel": ["углеродистая сталь", "CS", "сталь углерод.", "C-steel", "сталь углеродистая"],
    "Stainless steel AISI 304": ["AISI 304", "нерж. 304", "SS304", "нерж. сталь 304", "304"],
    "Stainless steel AISI 316L": ["316L", "SS316L", "нерж. сталь 316L", "AISI 316L", "нерж. 316L"],
    "Duplex steel": ["дуплексная сталь", "duplex", "дуплекс"],
    "Grey cast iron": ["GCI", "серый чугун", "чугун серый"],
    "Nickel aluminium bronze": ["Ni-Al bronze", "никель-алюминиевая бронза", "NAB"],
    "Titanium grade 2": ["Ti gr.2", "Ti-2", "титан 2", "титан марки 2"],
    "Glass reinforced plastic": ["fibreglass", "fiberglass", "стеклопластик", "GRP"],
    "Electric motor": ["электродвигатель", "E-motor", "el. motor"],
    "Steam turbine": ["паровая турбина"],
    "Diesel engine": ["дизель", "дизельный двигатель", "diesel"],
    "Pneumatic actuator": ["пневмопривод", "air actuator", "пневматический привод"],
    "Hydraulic actuator": ["гидропривод", "hydr. actuator", "гидравлический привод"],
    "Hand wheel": ["маховик", "manual wheel", "handwheel"],
    "Demineralised water": ["DMW", "обессоленная вода", "demin water"],
    "Natural gas": ["NG", "природный газ"],
    "Lubricating oil": ["LO", "смазочное масло", "lube oil"],
    "Instrument air": ["IA", "воздух КИП"],
    "Triethylene glycol": ["TEG", "ТЭГ", "триэтиленгликоль"],
    "Seawater": ["морская вода", "sea water"],
    "Steam condensate": ["конденсат", "condensate"],
    "Liquid nitrogen": ["жидкий азот", "LIN"],
    "Flameproof enclosure": ["Ex d", "взрывонепроницаемая оболочка", "explosion-proof"],
    "Intrinsic safety": ["Ex i", "искробезопасная цепь", "IS circuit"],
    "Increased safety": ["Ex e", "повышенная защита"],
    "Pressurised enclosure": ["Ex p", "под избыточным давлением"],
    "Encapsulation": ["Ex m", "герметизация компаундом"],
    "Weatherproof only": ["safe area", "без взрывозащиты"],
    "Raised face flange": ["RF", "фланец с выступом", "flange RF"],
    "Ring joint flange": ["RTJ", "фланец под овальное кольцо"],
    "Butt weld": ["BW", "butt-welded", "под приварку встык"],
    "Socket weld": ["SW", "socket-welded", "под приварку враструб"],
    "Threaded": ["screwed", "резьбовое", "NPT thread"],
    "Compression fitting": ["tube fitting", "обжимной фитинг"],
    "Hub clamp": ["хомут"],
    "Norvik Rotating GmbH": ["Norvik", "Norvik Rot.", "НОРВИК"],
    "Altamer Works Ltd": ["Altamer", "Альтамер"],
    "Kestrin Valves SpA": ["Kestrin", "Кестрин"],
    "Borealit JSC": ["Borealit", "АО Бореалит", "Бореалит"],
    "Pelagor Systems": ["Pelagor", "Pelagor Sys.", "Пелагор"],
    "Quintal Gas Equipment": ["Quintal", "Квинтал"],
    "Tarnholm Electric": ["Tarnholm", "Tarnholm El.", "Тарнхольм"],
    "Ulvik Process AS": ["Ulvik", "Ульвик"],
    "Vostrel Pumps": ["Vostrel", "Вострел"],
    "Wendover Skids plc": ["Wendover", "Вендовер"],
    "Epoxy primer": ["грунт эпоксидный", "эпоксидный грунт"],
    "Zinc silicate": ["цинксиликат", "inorganic zinc"],
    "Polyurethane topcoat": ["PU topcoat", "полиуретановая эмаль"],
    "Hot-dip galvanising": ["HDG", "горячее цинкование"],
    "Thermal spray aluminium": ["TSA", "металлизация алюминием"],
    "Uncoated": ["bare metal", "без покрытия"],
}
# Notes that stand behind an entry and say nothing about it.
NOTES = r"(?iu)\s*(?:\((?:std|по тз)\)|,? new|[–-] ?vendor std|[*;.])\s*$"
# --------------------------------------------------------------------------------------------------
LEAST = 0.45
LEAST_UNIT, SHORT_UNIT = 0.6, 6
UNIT_LISTS = "uom_"
MANY_ENTRIES = 200_000


def entry_key(entry: Column, list_name: Column) -> Column:
    """The entry without case, look-alike letters, invisible characters, notes behind it and signs between words; units by their own key."""
    plain = F.regexp_replace(squeeze(entry), f"[{INVISIBLE}]", "")
    text = F.regexp_replace(F.regexp_replace(plain, NOTES, ""), NOTES, "")
    words = F.trim(F.regexp_replace(F.lower(latin_looks(F.lower(latin_looks(text)))), r"[^\p{L}\p{N}]+", " "))
    return F.when(list_name.startswith(UNIT_LISTS), unit_key(F.regexp_replace(plain, f"[{INVISIBLE}]", ""))).otherwise(words)


def tokens(key: Column) -> Column:
    """The set of character pairs of each word with its borders; word order doesn't count."""
    word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(F.split(key, " "), word)))


def similar(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(block, left_key, right_key, jaccard): all pairs of one block whose token sets have a Jaccard similarity of least or more.

    left and right have (block, key, tokens), keys distinct within a block. Tokens are put in order of their rarity
    over both sides; two sets that similar share a token among their first |x| - ceil(least * |x|) + 1, so only these
    are joined; pairs whose lengths or first shared places rule the similarity out are dropped, the rest verified
    exactly.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    spread = both.select("side", "block", "key", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("block", "token").agg(F.count("*").alias("n"))
    ordered = (
        spread.join(rarity, ["block", "token"])
        .groupBy("side", "block", "key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("t"))
        .withColumn("size", F.size("t"))
        .withColumn("prefix", F.expr(f"slice(t, 1, cast(size - ceil({least} * size - 1e-9) + 1 as int))"))
    )
    half = lambda side, name: ordered.filter(F.col("side") == side).select("block", F.col("key").alias(name), F.col("t").alias(f"{name}_t"), F.col("size").alias(f"{name}_n"), F.posexplode("prefix").alias(f"{name}_at", "token"))
    a, b = half(0, "left_key"), half(1, "right_key")
    need = F.expr(f"ceil({least} / (1 + {least}) * (left_key_n + right_key_n) - 1e-9)")
    pairs = (
        a.join(b, ["block", "token"])
        .filter(f"right_key_n >= {least} * left_key_n - 1e-9 and left_key_n >= {least} * right_key_n - 1e-9")
        .groupBy("block", "left_key", "right_key")
        .agg(F.min(F.struct("left_key_at", "right_key_at")).alias("at"), *(F.first(c).alias(c) for c in ("left_key_t", "right_key_t", "left_key_n", "right_key_n")))
        .filter(F.least(F.col("left_key_n") - F.col("at.left_key_at"), F.col("right_key_n") - F.col("at.right_key_at")) >= need)
    )
    shared = F.size(F.array_intersect("left_key_t", "right_key_t"))
    return pairs.withColumn("shared", shared).withColumn("jaccard", F.col("shared") / (F.col("left_key_n") + F.col("right_key_n") - F.col("shared"))).filter(F.col("jaccard") >= least).select("block", "left_key", "right_key", "jaccard")


def known_names(spark: SparkSession) -> DataFrame:
    """(item, form): the names and unit spellings by which items are also known, the default aliases."""
    return spark.createDataFrame([(k, a) for k, v in [*KNOWN_AS.items(), *UNIT_SPELLINGS.items()] for a in v], "item string, form string")


def reference_forms(allowed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(list_name, item_id, key): every item of every list under its own name and, with aliases (item, form), the names it is also known by."""
    items = allowed.select("list_name", "item", "item_id").filter("item is not null")
    forms = items.withColumn("form", F.col("item"))
    if aliases is not None:
        forms = forms.unionByName(items.join(aliases.select("item", "form"), "item").select("list_name", "item", "item_id", "form"))
    return forms.groupBy("list_name", entry_key(F.col("form"), F.col("list_name")).alias("key")).agg(F.min("item_id").alias("item_id")).filter("key != ''")


def entries(register: DataFrame, properties: DataFrame, validations: DataFrame) -> DataFrame:
    """(row_id, target_col, list_name, entry): the register's entries in columns that a list governs, without missing marks."""
    lists = validations.groupBy("prop_id", "target_col").agg(F.min("list_name").alias("list_name"))
    keep = ["row_id", "property_value", "uom"]
    rows = with_property(register.select(*keep, "property_name", "property_name_rus"), properties, keep, lists)
    entry = F.when(F.col("target_col") == "uom", F.col("uom")).when(F.col("target_col") == "property_value", F.col("property_value"))
    return rows.select("row_id", "target_col", "list_name", F.explode(F.array(entry)).alias("entry")).filter(~is_missing(F.col("entry")))


def to_items(found: DataFrame, allowed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """found (list_name, entry, any other columns) with item_id, or -1 where the entry stands for no item of its list.

    Each distinct entry is matched once; the most similar form wins, ties by the smaller item_id. Units shorter than
    SHORT_UNIT characters must be equal to a form, as two units of one list may differ in a single letter (m, mm, cm;
    W, kW, MW), so that the nearest form says nothing; longer ones must be similar by LEAST_UNIT, other entries by
    LEAST. The answers are joined by a broadcast where they were counted to be few.
    """
    distinct = cut(found.select("list_name", "entry").distinct().withColumn("key", F.explode(F.array(entry_key(F.col("entry"), F.col("list_name"))))))
    probes = distinct.filter("key != ''").select(F.col("list_name").alias("block"), "key").distinct().withColumn("tokens", tokens(F.col("key")))
    forms = cut(reference_forms(allowed, aliases))
    refs = forms.select(F.col("list_name").alias("block"), "key", tokens(F.col("key")).alias("tokens"))
    pairs = similar(probes, refs)
    unit = F.col("block").startswith(UNIT_LISTS)
    sure = (F.col("left_key") == F.col("right_key")) | ~unit | ((F.length("left_key") >= SHORT_UNIT) & (F.length("right_key") >= SHORT_UNIT) & (F.col("jaccard") >= LEAST_UNIT))
    best = (
        pairs.filter(sure)
        .join(forms.select(F.col("list_name").alias("block"), F.col("key").alias("right_key"), "item_id"), ["block", "right_key"])
        .groupBy(F.col("block").alias("list_name"), F.col("left_key").alias("key"))
        .agg(F.max_by("item_id", F.struct("jaccard", F.col("left_key") == F.col("right_key"), -F.col("item_id"))).alias("item_id"))
    )
    mapping = distinct.join(best, ["list_name", "key"], "left").select("list_name", "entry", F.coalesce("item_id", F.lit(-1)).cast("int").alias("item_id"))
    return found.join(broadcast_if_small(cut(mapping), MANY_ENTRIES), ["list_name", "entry"])


def free_entries(register: DataFrame, properties: DataFrame, validations: DataFrame, allowed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(row_id, target_col, item_id) of the entries that are not character for character an item of their list.

    aliases (item, form) adds other names of items, such as known_names(); without it items are found by similarity
    to their own names only. Null, blank and missing entries, rows without a known property and properties without a
    list give no row; repeated rows come out each; an entry that stands for nothing has item_id -1. The entries are
    cut from their lineage, as they are read for their distinct texts and again for the answers.
    """
    exact = broadcast_if_small(allowed.select("list_name", F.col("item").alias("entry")).distinct())
    typed = cut(entries(register, properties, validations).join(exact, ["list_name", "entry"], "left_anti"))
    return to_items(typed, allowed, aliases).select("row_id", "target_col", "item_id")
