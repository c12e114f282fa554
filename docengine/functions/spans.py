"""Numbers with units as spans of a text: every rule by itself, conflicts resolved, units taken from what stands around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import let, running_sums

NUMBER = r"\d+(?:[.,]\d+)?"

#: What stands behind a number for a unit, with what may not follow. Fixed values.
RULES = (
    ("mm²", rf"(?iu)({NUMBER})\s*(?:mm[²2]|mm\^2|mm\s*p\s*atrat)"),
    ("A/mm²", rf"(?iu)({NUMBER})\s*(?:A\s*/\s*mm[²2]|A/mm\^2|A\s*pe\s*mm)"),
    ("kVA", rf"(?iu)({NUMBER})\s*(?:kVA)"),
    ("kV", rf"(?iu)({NUMBER})\s*(?:kV)(?!A)"),
    ("V", rf"(?iu)({NUMBER})\s*(?:V)(?!\w|A|l)"),
    ("A", rf"(?iu)({NUMBER})\s*(?:A)(?!\w|l|n|m|s|\.)"),
    ("Ω", rf"(?iu)({NUMBER})\s*(?:[ΩΩ]|ohmi?|ohms?)"),
    ("s", rf"(?iu)({NUMBER})\s*(?:s)(?!\w|e|i|t|a)"),
    ("m", rf"(?iu)(?<!\d)({NUMBER})\s*(?:m|metri?)(?![a-z²2])"),
    ("°C", rf"(?iu)({NUMBER})\s*(?:°C|grade\s*C)"),
    ("MΩ", rf"(?iu)({NUMBER})\s*(?:M[ΩΩ]|Mohm|megaohmi?)"),
)

#: A number with a unit of a quiz, and the unit's own spelling. Fixed values.
QUIZ_UNIT = rf"(?iu)({NUMBER})\s*([ΩΩ]|ohms?|ohmi?|m|mm?[²2]|a|v|ma|kw|cm)"

#: A bound whose unit is missing, the words around it that say that it is a resistance, and how far they may be. Fixed values.
BOUND = rf"(?iu)cel\s+mult\s+({NUMBER})\s*[:;]"
RESISTANCE = r"(?iu)rezisten[aă]\s+prizei|priz[aă]\s+de\s+p[aă]m[aâ]nt|protec[tț]ia\s+mpotriva\s+siocurilor|protectia\s+impotriva\s+siocurilor|protec[tț]ie\s+impotriva\s+trasnetelor"
AROUND = 100


#: Where a rule may match: a number and up to ten more characters, white space aside, over again where a number begins among them.
#: The rules' units and what may not follow them are shorter, so each match lies in one region with all that it looks at.
REGION = r"(?:\d[\d.,]*+\s*+(?:[^\d\s]\s*+){0,10}+)++"


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """The matches of a pattern: array of struct(start, stop, groups), places from 0 and without the stop."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]

    def placed(p: Column) -> Column:
        stops = running_sums(F.transform(p["hits"], lambda x, i: F.char_length(F.get(p["gaps"], i)) + F.char_length(x)))

        def one(ends: Column) -> Callable[[Column, Column], Column]:
            return lambda x, i: F.struct((F.get(ends, i) - F.char_length(x)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("stop"), F.array(*[F.get(p[f"g{g}"], i) for g in groups]).alias("groups"))

        return let(stops, lambda ends: F.transform(p["hits"], one(ends)))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), *parts), placed)


def number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit(".")).cast("double")


def _of_rule(rule: int, unit: str, pattern: str) -> Callable[[Column], Column]:
    own = lambda first: lambda m: F.struct((first + m["start"]).alias("start"), (first + m["stop"]).alias("stop"), F.lit(rule).alias("rule"), F.lit(unit).alias("unit"), number(m["groups"][0]).alias("value"))
    return lambda r: F.transform(matches(r["said"], pattern, 1), own(r["start"]))


def unit_spans(text: Column, rules: tuple[tuple[str, str], ...] = RULES, region: str = REGION) -> Column:
    """All numbers with units, rule by rule: array of struct(start, stop, rule, unit, value); one number may have several units.

    The text is looked through for the regions around its numbers, and only
    these by each rule; ``region`` must hold whatever a rule looks at.
    """
    cut = F.transform(matches(text, region, 0), lambda m: F.struct(m["start"].alias("start"), m["groups"][0].alias("said")))
    return let(cut, lambda regions: F.concat(*[F.flatten(F.transform(regions, _of_rule(k, unit, pattern))) for k, (unit, pattern) in enumerate(rules)]))


def resolved(spans: Column) -> Column:
    """Those of overlapping spans that begin first; of these the longest, then the earlier rule; in the text's order.

    ``spans``: array of struct(start, stop, rule, unit, value).
    """
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("by"), s["rule"].alias("rule"), s["unit"].alias("unit"), s["value"].alias("value"))))
    nothing = F.struct(F.lit(-1).alias("end"), F.array_repeat(F.lit(-1), F.lit(0)).alias("places"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["end"]
        places = F.when(free, F.concat(acc["places"], F.array(acc["at"]))).otherwise(acc["places"])
        return F.struct(F.when(free, -s["by"]).otherwise(acc["end"]).alias("end"), places.alias("places"), (acc["at"] + 1).alias("at"))

    def chosen(rows: Column) -> Column:
        own = lambda i: F.struct(F.get(rows, i)["start"].alias("start"), (-F.get(rows, i)["by"]).alias("stop"), F.get(rows, i)["rule"].alias("rule"), F.get(rows, i)["unit"].alias("unit"), F.get(rows, i)["value"].alias("value"))
        return F.transform(F.aggregate(rows, nothing, step, lambda acc: acc["places"]), own)

    return let(in_order, chosen)


def quiz_values(text: Column) -> Column:
    """Numbers with a quiz's units, and bounds without a unit that the words around them make resistances.

    Array of struct(start, value, unit).  Such a bound counts once, and not where
    its value is there in ohms already.
    """

    def unit(u: Column) -> Column:
        low = F.lower(u)
        return F.when(low.isin("ω", "ohm", "ohms", "ohmi"), "Ω").when(low == "mm2", "mm²").when(low == "m2", "m²").otherwise(low)

    plain = F.transform(matches(text, QUIZ_UNIT, 1, 2), lambda m: F.struct(m["start"].alias("start"), number(m["groups"][0]).alias("value"), unit(m["groups"][1]).alias("unit")))
    bounds = F.filter(matches(text, BOUND, 1), lambda m: text.substr(F.greatest(m["start"] - AROUND, F.lit(0)) + 1, m["stop"] + AROUND - F.greatest(m["start"] - AROUND, F.lit(0))).rlike(RESISTANCE))
    more = F.transform(bounds, lambda m: F.struct(m["start"].alias("start"), number(m["groups"][0]).alias("value"), F.lit("Ω").alias("unit")))
    fresh = F.filter(more, lambda m: ~F.exists(plain, lambda p: (p["unit"] == "Ω") & (F.abs(p["value"] - m["value"]) < 0.1)))
    none = F.filter(fresh, lambda m: F.lit(False))
    once = F.aggregate(fresh, none, lambda acc, m: F.when(F.exists(acc, lambda p: F.abs(p["value"] - m["value"]) < 0.1), acc).otherwise(F.concat(acc, F.array(m))))
    return F.concat(plain, once)
