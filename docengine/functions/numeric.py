"""Numbers with units: questions about them, finding them and scoring them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import contains_any, running_sums

NUMBER = r"\d+[\s,.]?\d*"

#: Unit names and the spellings they have behind a number, case-insensitive. Fixed values.
UNITS = (
    ("mm", "mm|milimetri"),
    ("cm", "cm|centimetri"),
    ("m", "(?:m|metri)(?!m)"),
    ("A", "A|amperi"),
    ("V", "V|volti"),
    ("Ω", "Ω|ohmi"),
    ("kW", "kW|kilowatti"),
    ("mm²", "mm²|mm2"),
    ("%", "%"),
    ("°C", r"°C|grade\s*Celsius"),
)


def parse_number(raw: Column) -> Column:
    """A number with inner spaces and a decimal comma; null if it is none."""
    clean = F.replace(F.regexp_replace(raw, r"\s", ""), F.lit(","), F.lit("."))
    return F.regexp_extract(clean, r"^\d+\.?\d*", 0).try_cast("double")


def shown_number(value: Column) -> Column:
    """A number as text: whole ones as such, others in plain digits; with a power of ten below 0.0001 and for whole ones from 9e18."""
    said = value.cast("string")
    plain = lambda kind: F.regexp_replace(said.cast(kind).cast("string"), r"\.?0+$", "")
    power = F.substring_index(said, "E", -1).cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    digits = F.abs(power).cast("string")
    short = F.concat(F.regexp_replace(F.substring_index(said, "E", 1), r"\.0$", ""), sign, F.lpad(digits, F.greatest(F.char_length(digits), F.lit(2)), "0"))
    size = F.abs(value)
    return (
        F.when((value == F.floor(value)) & (value < 9e18), value.cast("long").cast("string"))
        .when(said == "Infinity", "inf")
        .when(~F.contains(said, F.lit("E")), said)
        .when((size >= 1e7) & (size < 1e16), plain("decimal(38,18)"))
        .when((size >= 1e-4) & (size < 1), plain("decimal(38,36)"))
        .otherwise(short)
    )


def numeric_question(text: Column) -> Column:
    """What a question asks about a number: struct of unit, target, minimum, maximum and tolerance in percent; null without one."""
    low = F.lower(text)
    value = parse_number(F.regexp_extract(text, f"({NUMBER})", 1))
    unit = F.nullif(F.lower(F.regexp_extract(text, rf"(?i){NUMBER}\s*(mm|cm|m|A|V|Ω|kW|%|grade|°C)", 1)), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    ranged = (contains_any(low, ("între", "intre")) | F.contains(text, F.lit("-"))) & (F.size(numbers) >= 2)
    least = ~ranged & contains_any(low, ("minim", "cel puțin", "≥"))
    most = ~ranged & ~least & contains_any(low, ("maxim", "cel mult", "≤"))
    exact = ~ranged & ~least & ~most
    # The ends of a range are read as they stand, without a decimal comma.
    end = lambda i: F.regexp_extract(F.trim(F.try_element_at(numbers, F.lit(i))), r"^\d+\.?\d*", 0).try_cast("double")
    return F.when(
        value.isNotNull(),
        F.struct(
            unit.alias("unit"),
            F.when(exact, value).alias("target"),
            F.when(ranged, end(1)).when(least, value).alias("minimum"),
            F.when(ranged, end(2)).when(most, value).alias("maximum"),
            F.when(ranged, 0.0).when(exact, 10.0).otherwise(5.0).alias("tolerance"),
        ),
    )


def _found(text: Column, pattern: str, unit: str, around: int) -> Column:
    """The matches of one unit with their values and up to ``around`` characters on both sides of each."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    ends = running_sums(F.transform(hits, lambda x, i: F.char_length(F.get(gaps, i)) + F.char_length(x)))

    def one(x: Column, i: Column) -> Column:
        stop, size = F.get(ends, i), F.char_length(x)
        first = F.greatest(stop - size - around, F.lit(0))
        context = F.trim(text.substr(first + 1, stop + around - first))
        return F.struct(parse_number(F.get(raw, i)).alias("value"), F.lit(unit).alias("unit"), context.alias("context"))

    return F.transform(hits, one)


def _plain(unit: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(parse_number(x).alias("value"), F.lit(unit).alias("unit"), F.lit("").alias("context"))


def measurements(text: Column, contexts: bool = False, around: int = 50) -> Column:
    """All numbers with units: array of struct(value, unit, context), unit by unit; the context is empty unless asked for."""
    found = []
    for unit, spelling in UNITS:
        pattern = rf"(?i)({NUMBER})\s*(?:{spelling})"
        if contexts:
            found.append(_found(text, pattern, unit, around))
        else:
            plain = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            found.append(F.transform(plain, _plain(unit)))
    codes = F.regexp_extract_all(text, F.lit(r"(?i)IP\s*(\d{2})"), F.lit(1))
    found.append(F.transform(codes, lambda x: F.struct(x.cast("double").alias("value"), F.lit("IP").alias("unit"), F.lit("").alias("context"))))
    return F.concat(*found)


def match_score(value: Column, unit: Column, question: Column) -> Column:
    """How well a number fits a question: unit 30, exact value up to 50, bounds 40 and 10 if near."""
    q = question
    gap = F.abs(value - q["target"])
    room = q["target"] * q["tolerance"] / 100
    exact = F.when(gap <= room, F.when(room == 0, 50.0).otherwise(50 * (1 - gap / room))).otherwise(0.0)
    low = F.when(value >= q["minimum"], 40 + F.when(value - q["minimum"] < q["minimum"] * 0.2, 10).otherwise(0)).otherwise(0)
    high = F.when(value <= q["maximum"], 40 + F.when(q["maximum"] - value < q["maximum"] * 0.2, 10).otherwise(0)).otherwise(0)
    same = F.when(F.lower(unit) == q["unit"], 30).otherwise(0)
    return same + F.coalesce(exact, F.lit(0.0)) + F.coalesce(low, F.lit(0)) + F.coalesce(high, F.lit(0))


#: What a question measures, in the order tried: words, name and default unit. Fixed values.
MEASURED = (
    (("distanță", "distant", "spațiu", "spatiu", "de la", "între", "intre"), "distance", None),
    (("înălțime", "inaltime"), "height", None),
    (("secțiune", "sectiune", "suprafață", "suprafata", "mm²", "mm2"), "section", "mm²"),
    (("curent", "amper", "intensitate"), "current", "A"),
    (("tensiune", "volt"), "voltage", "V"),
)


def measured_quantity(text: Column) -> Column:
    """Struct of type, value and unit; null if the question measures nothing known."""
    q = numeric_question(text)
    out = F.lit(None).cast("struct<type:string,value:double,unit:string>")
    for words, name, unit in reversed(MEASURED):
        out = F.when(contains_any(text, words), F.struct(F.lit(name).alias("type"), q["target"].alias("value"), F.coalesce(q["unit"], F.lit(unit)).alias("unit"))).otherwise(out)
    return out
