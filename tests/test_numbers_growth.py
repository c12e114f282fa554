"""Numbers of options, shown numbers and unit spans: one look at the texts, whatever the options and rules."""

import random
import re

from pyspark.sql import functions as F

from docengine.functions import numeric, spans
from docengine.operators import answers, patterns


def test_options_do_not_multiply_the_reading_of_texts(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK_PATTERNS", 1)
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789.,  askVm²/2") for _ in range(40)) for _ in range(60)] + ["5 mm27mm2", "1.234,5a", "9" * 400 + " kV", "5. a", "12 v", None]
    said = ["5 A", "27 mm2", "4,5 A", "7 s", "99 kV", "3 m", "2.50 A/mm2", "12 V", "77777777 A", "1.5 kVA"]
    options = spark.createDataFrame([(q, "a", o) for q, o in enumerate(said)], "question_id long, letter string, option string")
    got = patterns.first_numeric_hit(options, spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    ends = {u: "|".join(s) for u, _, s in patterns.OPTION_UNITS}
    want = {}
    rows = patterns.option_values(options).withColumn("formats", patterns._formats(F.col("value"))).orderBy("question_id", "letter", "place").collect()
    for r in rows:
        regex = "(?:" + "|".join(f.replace(".", r"\.?") for f in r["formats"]) + rf")\s*(?:{ends[r['unit']]})"
        if any(re.search(regex, t.lower(), re.A | re.I if regex.isascii() else re.I) for t in texts if t):
            want.setdefault(r["question_id"], (r["value"], r["unit"]))
    assert {r["question_id"]: (r["value"], r["unit"]) for r in got.collect()} == want and 4 < len(want) < len(said)


def test_shown_numbers_have_one_form(spark):
    want = {4.208486635120169e19: "4.208486635120169e+19", 1e19: "1e+19", 12345678.5: "12345678.5", 0.00005: "5e-05", 0.0005: "0.0005", 30.0: "30", 2.5: "2.5", float("inf"): "inf"}
    rows = spark.createDataFrame([(v,) for v in want], "v double").select("v", numeric.shown_number(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in rows} == want
    text = F.lit("42084866351201690000 A, 12345678,5 mm")
    assert spark.range(1).select(answers.shown_numbers(numeric.measurements(text))).first()[0] == "**12345678.5 mm**\n**4.208486635120169e+19 A**"


def _span(rule, unit):
    return lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(rule).alias("rule"), F.lit(unit).alias("unit"), spans.number(m["groups"][0]).alias("value"))


def test_rules_read_the_regions_of_numbers_alone(spark):
    rng = random.Random(8)
    pieces = [*"0123456789., ²2^aAmMsSvVkKeilt", "mm", "MΩ", "Mohm", "grade  C", "mm  p  atrat", "A pe mm", "megaohmi", "°C", "\n", "word word ", " " * 30]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)] + ["x" * 50 + "5 m", "5mm27mm2", "1 m2 m3 m 4 A", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.concat(*[F.transform(spans.matches(F.col("t"), p, 1), _span(k, u)) for k, (u, p) in enumerate(spans.RULES)])
    rows = df.select(whole.alias("want"), spans.unit_spans(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(len(r["got"]) for r in rows) > 100
    plan = df.select(spans.unit_spans(F.col("t")).alias("got"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(t#") == 1  # the text itself is cut once
