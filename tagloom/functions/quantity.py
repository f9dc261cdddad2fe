"""Reading of numbers, ranges, dates, flags and units from free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import latin_looks, let, missing_text, squeeze

# --- fixed values ---------------------------------------------------------------------------------
# Signs for "about" and "at most" before a number.
QUALIFIERS = r"(?:~|≈|∼|ca\.?|approx\.?|about|около|примерно|≤|<=?|max\.?|не более|up to)"
# Factor and offset to the common unit of each list: base = (value + before) * factor.
UNITS = {
    "uom_pressure": {"bar": (1, 0), "kPa": (0.01, 0), "MPa": (10, 0), "psi": (0.45359237 * 9.80665 / 0.0254**2 / 1e5, 0), "kgf/cm2": (0.980665, 0), "mbar": (0.001, 0)},
    "uom_temperature": {"°C": (1, 0), "K": (1, -273.15), "°F": (5 / 9, -32)},
    "uom_length": {"mm": (1, 0), "cm": (10, 0), "m": (1000, 0), "in": (25.4, 0)},
    "uom_mass": {"kg": (1, 0), "t": (1000, 0), "g": (0.001, 0), "lb": (0.45359237, 0)},
    "uom_flow": {"m3/h": (1, 0), "l/min": (0.06, 0), "l/s": (3.6, 0), "m3/s": (3600, 0)},
    "uom_power": {"kW": (1, 0), "W": (0.001, 0), "MW": (1000, 0)},
    "uom_voltage": {"V": (1, 0), "kV": (1000, 0), "mV": (0.001, 0)},
    "uom_current": {"A": (1, 0), "mA": (0.001, 0), "kA": (1000, 0)},
    "uom_volume": {"m3": (1, 0), "l": (0.001, 0), "cm3": (1e-6, 0)},
    "uom_speed": {"rpm": (1, 0), "rev/s": (60, 0)},
    "uom_duration": {"s": (1, 0), "ms": (0.001, 0), "min": (60, 0), "h": (3600, 0)},
}
# Other spellings of the units; case, spaces, dots, superscripts and look-alike letters don't count.
UNIT_SPELLINGS = {
    "bar": ["bars", "barg", "bar(g)", "bara", "бар", "бар изб", "бари"],
    "kPa": ["kpa(g)", "кПа", "кПа изб", "kilopascal", "kilopascals"],
    "MPa": ["MPa(g)", "МПа", "МПа изб", "megapascal", "megapascals"],
    "psi": ["psig", "lbf/in2", "lb/sqin", "lbf/sqin", "фунт/дюйм2"],
    "kgf/cm2": ["кгс/см2", "kgf/sqcm", "kg/cm2", "кг/см2", "кгс/кв.см"],
    "mbar": ["mbarg", "mbar(g)", "millibar", "millibars", "мбар"],
    "°C": ["degC", "deg C", "grad C", "град С", "C", "celsius"],
    "K": ["deg K", "kelvin", "kelvins", "кельвин"],
    "°F": ["degF", "deg F", "F", "fahrenheit"],
    "mm": ["mms", "мм", "millimetre", "millimetres", "millimeter", "millimeters"],
    "cm": ["cms", "см", "centimetre", "centimetres", "centimeter", "centimeters"],
    "m": ["mtr", "м", "metre", "metres", "meter", "meters"],
    "in": ["inch", "inches", "дюйм", "дюйма", "дюймов", "''", '"', "″"],
    "kg": ["kgs", "кг", "kilogram", "kilograms", "kilo"],
    "t": ["т", "тонн", "тонна", "tonne", "tonnes", "metric ton", "ton", "tons"],
    "g": ["gr", "gram", "grams", "г", "гр"],
    "lb": ["lbs", "lbm", "pound", "pounds", "фунт"],
    "m3/h": ["м3/ч", "cbm/h", "cu.m/h", "m3/hr", "m3/hour", "куб.м/ч"],
    "l/min": ["lpm", "ltr/min", "л/мин"],
    "l/s": ["lps", "l/sec", "л/с", "л/сек"],
    "m3/s": ["м3/с", "cu.m/s", "m3/sec", "cbm/s"],
    "kW": ["kwatt", "kilowatt", "kilowatts", "кВт"],
    "W": ["watt", "watts", "Вт"],
    "MW": ["mwatt", "megawatt", "megawatts", "МВт"],
    "V": ["volt", "volts", "VAC", "VDC", "В", "вольт"],
    "kV": ["kvolt", "kilovolt", "kilovolts", "кВ"],
    "mV": ["mvolt", "millivolt", "millivolts", "мВ"],
    "A": ["amp", "amps", "ampere", "ampers", "ампер", "А"],
    "mA": ["mamp", "milliamp", "milliamps", "мА"],
    "kA": ["kamp", "kiloamp", "kiloamps", "кА"],
    "m3": ["м3", "cbm", "cu.m", "куб.м"],
    "l": ["л", "ltr", "litre", "litres", "liter", "liters", "литр"],
    "cm3": ["см3", "ccm", "cu.cm", "cc", "куб.см"],
    "rpm": ["rev/min", "r/min", "1/min", "об/мин"],
    "rev/s": ["rps", "r/s", "1/s", "об/с"],
    "s": ["sec", "secs", "second", "seconds", "с", "сек"],
    "ms": ["msec", "millisec", "мс", "мсек"],
    "min": ["mins", "minute", "minutes", "мин"],
    "h": ["hr", "hrs", "hour", "hours", "ч", "час"],
}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
}
YES = ["yes", "y", "true", "1", "да", "д"]
NO = ["no", "n", "false", "0", "нет", "н"]
# --------------------------------------------------------------------------------------------------
PLAIN = r"(?:\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:\.\d{3})+,\d+|\d+(?:[.,]\d+)?)(?:[eE][+-]?\d+)?"
FRACTION = r"(?:\d+[ -])?\d+/\d+(?![\d/])"
NUMBER = rf"(?:minus |[+-] ?)?(?:{FRACTION}|{PLAIN})"
REST = r"((?![\d.,+\-/ ÷]|to |до ).{0,14})"


def unit_key(c: Column) -> Column:
    """What all spellings of one unit share."""
    t = F.translate(latin_looks(F.lower(latin_looks(c))), "²³ºв", "23°b")
    t = F.regexp_replace(F.regexp_replace(t, "℃|°\\s*c", "°c"), "℉|°\\s*f", "°f")
    return F.regexp_replace(t, r"[\s\p{Z}.]+", "")


def unit_table(spark: SparkSession, allowed: DataFrame) -> DataFrame:
    """(list_name, unit_key, item_id, item, factor, before): every known spelling of the units that stand in the allowed lists; at most a row a spelling of UNITS and UNIT_SPELLINGS."""
    rows = [(k, u, a, float(f), float(b)) for k, us in UNITS.items() for u, (f, b) in us.items() for a in [u, *UNIT_SPELLINGS[u]]]
    known = spark.createDataFrame(rows, "list_name string, item string, spelling string, factor double, before double")
    own = F.col("list_name").isin(list(UNITS)) & F.col("item").isin(sorted({u for us in UNITS.values() for u in us}))
    items = allowed.filter(own).groupBy("list_name", "item").agg(F.min("item_id").alias("item_id"))  # at most one a unit of UNITS
    return (
        known.join(F.broadcast(items), ["list_name", "item"])
        .withColumn("unit_key", unit_key(F.col("spelling")))
        .groupBy("list_name", "unit_key")
        .agg(F.min(F.struct("item_id", "item", "factor", "before")).alias("u"))
        .select("list_name", "unit_key", "u.*")
    )


def _digit_first(s: Column) -> Column:
    return F.substring(s, 1, 1).between("0", "9")


def as_number(s: Column) -> Column:
    """The double that a text matching NUMBER stands for, else null."""
    sign = F.when(s.startswith("minus") | s.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    part = lambda t, i: F.regexp_extract(t, r"^(?:(\d+)[ -])?(\d+)/(\d+)$", i).try_cast("double")
    fraction = lambda t: F.coalesce(part(t, 1), F.lit(0.0)) + part(t, 2) / F.nullif(part(t, 3), F.lit(0.0))

    def plain(bare: Column) -> Column:
        both = bare.contains(",") & bare.contains(".")
        comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
        return F.when(both & comma_last, F.translate(bare, ",.", ".")).when(both, F.translate(bare, ",", "")).otherwise(F.translate(bare, ",", ".")).try_cast("double")

    bare = F.when(_digit_first(s), s).otherwise(F.regexp_replace(s, r"^(?:minus |[+-] ?)", ""))
    return sign * let(bare, lambda t: F.when(t.contains("/"), fraction(t)).otherwise(let(F.translate(t, " '", ""), plain)))


CUT = "\u0001"  # between the parts of a value that was taken apart


def quantity(v: Column) -> Column:
    """struct<low, high, unit>: a number (high is null) or a range in order, and the text after it; low is null where v reads as neither."""
    return read_quantity(squeeze(v))


def read_quantity(v: Column) -> Column:
    """quantity of a text that squeeze has gone over. Each pattern takes the value apart in one pass; most values need one pattern."""
    one = rf"^({NUMBER}) ?{REST}$"
    two = rf"^(?:от )?({NUMBER}) ?(?:\.\.\.|-|÷|to|до) ?({NUMBER}) ?{REST}$"
    nothing = F.lit(None).cast("struct<low:double,high:double,unit:string>")

    def plain(t: Column) -> Column:
        t = F.replace(F.translate(t, "−–—‒", "----"), F.lit("…"), F.lit("..."))
        per = let(F.regexp_replace(t, r"(?<=\d) ?1/(min|s)$", " per $1"), lambda x: F.regexp_replace(F.regexp_replace(x, r"per min$", "rpm"), r"per s$", "rev/s"))
        t = F.when(t.endswith("min") | t.endswith("s"), per).otherwise(t)
        return let(t, lambda x: F.when(_digit_first(x), x).otherwise(F.regexp_replace(x, rf"(?iu)^{QUALIFIERS} ?(?=[\d+\-m])", "")))

    def single(x: Column) -> Column:
        return F.struct(as_number(F.substring_index(x, CUT, 1)).alias("low"), F.lit(None).cast("double").alias("high"), F.substring_index(x, CUT, -1).alias("unit"))

    def double(x: Column) -> Column:
        middle = F.substring_index(F.substring_index(x, CUT, 2), CUT, -1)
        ends = F.array_sort(F.array(as_number(F.substring_index(x, CUT, 1)), as_number(middle)))
        return let(ends, lambda e: F.struct(F.get(e, 0).alias("low"), F.get(e, 1).alias("high"), F.substring_index(x, CUT, -1).alias("unit")))

    def ranges(x: Column) -> Column:
        return let(F.regexp_replace(x, two, f"$1{CUT}$2{CUT}$3"), lambda y: F.when(y.contains(CUT), double(y)).otherwise(nothing))

    def read(x: Column) -> Column:
        return let(F.regexp_replace(x, one, f"$1{CUT}$2"), lambda y: F.when(y.contains(CUT), single(y)).otherwise(ranges(x)))

    digits = F.translate(v, "0123456789", "") != v
    return F.when(digits & ~v.contains(CUT), let(plain(v), read)).otherwise(nothing)


def base_milli(value: Column, factor: Column, before: Column) -> Column:
    """Value in the common unit times 1000 as a whole number, halves to the even one; noise of doubles is rounded away first."""
    x = F.round((value + before) * factor * 1000.0, 6)
    return F.bround(x, 0).cast("long")


def full_date(v: Column) -> Column:
    """The date of a full date (year first, day first or with the month's name in English or Russian), else null."""
    return read_date(squeeze(v))


def read_date(v: Column) -> Column:
    """full_date of a text that squeeze has gone over."""
    ymd = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$"
    dmy = r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$"
    dmw = r"^(\d{1,2})\.? ([a-zа-я]+),? (\d{4})(?: ?г\.?)?$"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def made(t: Column) -> Column:
        g = lambda p, i: F.regexp_extract(t, p, i)
        month = F.element_at(months, F.nullif(g(dmw, 2), F.lit("")))
        return (
            F.when(t.rlike(ymd), F.concat_ws("-", g(ymd, 1), F.lpad(g(ymd, 2), 2, "0"), F.lpad(g(ymd, 3), 2, "0")))
            .when(t.rlike(dmy), F.concat_ws("-", g(dmy, 3), F.lpad(g(dmy, 2), 2, "0"), F.lpad(g(dmy, 1), 2, "0")))
            .when(t.rlike(dmw), let(month, lambda m: F.when(m.isNotNull(), F.concat_ws("-", g(dmw, 3), F.lpad(m.cast("string"), 2, "0"), F.lpad(g(dmw, 1), 2, "0")))))
        )

    return let(F.lower(v), made).try_cast("date")


def flag(v: Column) -> Column:
    """True or false for a yes or a no in English or Russian, else null."""
    t = F.lower(squeeze(v))
    return F.when(t.isin(YES), F.lit(True)).when(t.isin(NO), F.lit(False))


def cell(v: Column, kind: Column) -> Column:
    """The text form of a typed cell, null where the value is missing or doesn't read as the kind.

    quantity: low|high|unit; date: yyyy-MM-dd; flag: true or false; anything else: the text itself, trimmed. White
    space is squeezed once, and only the row's own kind is read.
    """
    number = lambda t: let(read_quantity(t), lambda q: F.when(q["low"].isNotNull(), F.concat_ws("|", q["low"].cast("string"), F.coalesce(q["high"].cast("string"), F.lit("")), q["unit"])))
    yes_no = lambda t: F.when(F.lower(t).isin(YES), F.lit("true")).when(F.lower(t).isin(NO), F.lit("false"))

    def typed(t: Column) -> Column:
        read = F.when(kind == "quantity", number(t)).when(kind == "date", read_date(t).cast("string")).when(kind == "flag", yes_no(t)).otherwise(t)
        return F.when(~missing_text(t), read)

    return let(squeeze(v), typed)
