"""Many patterns at once: one automaton over each text instead of a search for every pair.

An Aho-Corasick automaton of a block of patterns finds all of them in one pass
over a text.  Which texts a block is looked for in does not depend on the
patterns' number, and each task adds up what it has found before the shuffle.
Quiz options, their numbers and words that restrict them are such patterns.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and characters in one block, on average: each task holds its automaton.
BLOCK_PATTERNS, BLOCK_CHARS = 50_000, 2_000_000

#: Numbers with units in quiz options: unit, where it stands behind a number, and how texts may write it behind the value. Fixed values.
OPTION_UNITS = (
    ("mm²", r"mm[²2]|mm\^2", (r"mm[²2^]", r"mm\s*sup", r"mm\^2")),
    ("A/mm²", r"A\s*/\s*mm[²2]|A/mm\^2", (r"A\s*/\s*mm[²2^]", r"A/mm")),
    ("kVA", r"kVA|kva", (r"kVA",)),
    ("kV", r"kV|kv", (r"kV",)),
    ("V", r"(?:V|v)(?![a-z])", (r"V(?!\w)",)),
    ("A", r"(?:A|a)(?![a-z])", (r"A(?!\w)",)),
    ("Ω", r"Ω|ohmi?", (r"[ΩΩ]", r"ohmi?", r"ohms?")),
    ("s", r"s|sec", (r"s(?!\w)", r"sec")),
    ("m", r"(?:m|metri?)(?![a-z²2])", (r"m(?!\w)", r"metri?")),
)

#: Confidence of an answer whose number the texts hold. Fixed value.
NUMERIC_CONFIDENCE = 95

@functools.lru_cache(maxsize=4)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(p, i)
    found.make_automaton()
    return found


def _blocks(patterns: DataFrame) -> Iterator[tuple[str, ...]]:
    """The different patterns in blocks of about the stated size, read to the driver one by one."""
    known = patterns.select("pattern").where("pattern <> ''").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("pattern")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_PATTERNS), -(-size["chars"] // BLOCK_CHARS)) if size["n"] else 0
    for b in range(blocks):
        rows = known if blocks == 1 else known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b)
        if block := tuple(sorted(r[0] for r in rows.collect())):
            yield block


def _each(patterns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of texts with each pattern that they hold and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns)
        for batch in batches:
            at, which, times = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                hits = Counter(k for _, k in automaton.iter(text)) if text else ()
                at += [i] * len(hits)
                which += hits
                times += hits.values() if hits else ()
            if at:
                kept = batch.take(pa.array(at))
                columns = [kept.column(c) for c in kept.schema.names if c != "_text"]
                names = [c for c in kept.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([patterns[k] for k in which], pa.string()), pa.array(times, pa.int64())], names=[*names, "pattern", "times"])

    return run


def _totals(patterns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many texts of a task hold each pattern, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, texts, times = _automaton(patterns), Counter(), Counter()
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                if text:
                    hits = Counter(k for _, k in automaton.iter(text))
                    texts.update(hits.keys())
                    times.update(hits)
        if texts:
            keys = list(texts)
            yield pa.RecordBatch.from_arrays([pa.array([patterns[k] for k in keys], pa.string()), pa.array([texts[k] for k in keys], pa.int64()), pa.array([times[k] for k in keys], pa.int64())], names=["pattern", "n_texts", "times"])

    return run


def _united(parts: list[DataFrame], texts: DataFrame, schema: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)


def find_patterns(texts: DataFrame, text: Column, patterns: DataFrame) -> DataFrame:
    """Which patterns each row's text holds: the columns of ``texts``, ``pattern`` and ``times``, overlapping ones counted.

    ``patterns`` has ``pattern``; empty ones are nowhere, equal ones are one.
    Letters count as they are.  A null text holds nothing.
    """
    columns = ", ".join(f"`{name}` {kind}" for name, kind in texts.dtypes)
    schema = f"{columns}, pattern string, times long"
    rows = texts.withColumn("_text", text)
    return _united([rows.mapInArrow(_each(block), schema) for block in _blocks(patterns)], texts, schema)


def count_patterns(texts: DataFrame, text: Column, patterns: DataFrame) -> DataFrame:
    """``pattern, n_texts, times`` of the patterns that some text holds; cases as in :func:`find_patterns`."""
    schema = "pattern string, n_texts long, times long"
    rows = texts.select(text.alias("_text"))
    found = _united([rows.mapInArrow(_totals(block), schema) for block in _blocks(patterns)], texts, schema)
    return found.groupBy("pattern").agg(F.sum("n_texts").alias("n_texts"), F.sum("times").alias("times"))


# ---- numbers of options


def _with_unit(unit: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(unit).alias("unit"), F.replace(v, F.lit(","), F.lit(".")).alias("value"))


def option_values(options: DataFrame) -> DataFrame:
    """The numbers with units of quiz options, in the order in which they are tried: ``question_id, letter, unit, value, place``.

    ``options``: ``question_id, letter, option``.  Every unit is looked for by
    itself, so one number may have several; a decimal comma becomes a point.
    """
    found = []
    for unit, pattern, _ in OPTION_UNITS:
        raw = F.regexp_extract_all("option", F.lit(rf"(?i)(\d+(?:[.,]\d+)?)\s*(?:{pattern})"), F.lit(1))
        found.append(F.transform(raw, _with_unit(unit)))
    each = options.select("question_id", "letter", F.posexplode(F.concat(*found)).alias("place", "v"))
    return each.select("question_id", "letter", "v.unit", "v.value", F.col("place").cast("long").alias("place"))


def _formats(value: Column) -> Column:
    """The spellings of a number: as it is, with a comma, as short as it goes, rounded."""
    number = value.cast("double")
    short = F.when(number == F.floor(number), F.format_string("%.0f", number)).otherwise(F.regexp_replace(F.regexp_replace(value, "0+$", ""), "^0+(?=\\d)", ""))
    return F.array_distinct(F.array(value, F.replace(value, F.lit("."), F.lit(",")), short, F.format_string("%.0f", F.floor(number + 0.5).cast("double"))))


def _cut(unit: str, longest: int) -> Callable[[Column], Column]:
    return lambda run: F.struct(F.lit(unit).alias("unit"), F.right(run, F.lit(longest)).alias("run"))


def _numbers_of(texts: DataFrame, text: Column, longest: int) -> DataFrame:
    """The different numbers that stand before a unit in some text: ``unit, number``.

    What stands there is a run of digits, points and commas; a number is an end
    of it, of at most ``longest`` characters.
    """
    low = F.lower(text)
    either = "|".join(s for _, _, spellings in OPTION_UNITS for s in spellings)
    rows = texts.select(low.alias("low")).where(F.col("low").rlike(rf"(?iu)[0-9]\s*(?:{either})"))
    runs = []
    for unit, _, spellings in OPTION_UNITS:
        run = rf"(?iu)(?<![0-9.,])[0-9.,]++(?<=[0-9])(?=\s*(?:{'|'.join(spellings)}))"
        runs.append(F.transform(F.regexp_extract_all("low", F.lit(run), F.lit(0)), _cut(unit, longest)))
    once = rows.select(F.explode(F.concat(*runs)).alias("r")).select("r.*").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.char_length("run")), lambda n: F.right("run", n))
    return once.select("unit", F.explode(F.filter(ends, lambda e: e.rlike("^[0-9]"))).alias("number")).distinct()


def first_numeric_hit(options: DataFrame, texts: DataFrame, text: Column) -> DataFrame:
    """The first option whose number some text holds with its unit: ``question_id, letter, value, unit, confidence``.

    Options go by letter, the numbers of an option by unit and place.  Texts are
    read once, however many options there are: their different numbers before a
    unit are joined with the spellings of the options' numbers, in which a
    decimal point may be missing.  Questions none of whose numbers is found have
    no row.
    """
    # Options, short rows that may lie in one split, are dealt out before their numbers are looked for.
    values = option_values(options.repartition(options.sparkSession.sparkContext.defaultParallelism, "question_id"))
    spelt = values.select("value", "unit").distinct().withColumn("formats", _formats(F.col("value")))
    plain = F.flatten(F.transform("formats", lambda f: F.array(f, F.regexp_replace(f, r"\.", ""))))
    numbers = spelt.select("value", "unit", F.explode(F.array_distinct(plain)).alias("number"))
    longest = numbers.agg(F.max(F.char_length("number"))).first()[0] or 0
    held = _numbers_of(texts, text, longest).join(numbers, ["unit", "number"]).select("value", "unit").distinct()
    first = Window.partitionBy("question_id").orderBy("letter", "place")
    hits = values.join(held, ["value", "unit"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    return hits.select("question_id", "letter", "value", "unit", F.lit(NUMERIC_CONFIDENCE).cast("long").alias("confidence"))
