"""Multiple-choice questions: detecting, parsing and answering them from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.numeric import measurements
from docengine.functions.text import let, strip_accents

SAMPLE = (
    (1, "Care este inaltimea minima de montare a unei prize", "30 mm", "50 mm", "80 mm", "b"),
    (2, "Which word comes with that", "that with", "from this", "pour dans", "a"),
    (3, "Ce curent are siguranta", "10 A", "16 A", "25 A", "b"),
)
OPTION_VALUES = ", ".join(f"({r[0]}, '{letter}', '{r[2 + k]}')" for r in SAMPLE for k, letter in enumerate("abc"))


def sample_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE), "question_id long, question string, varianta_a string, varianta_b string, varianta_c string, correct string")


def sample_evidence(spark: SparkSession) -> DataFrame:
    texts = ["Prizele se monteaza la minim 50 mm de pardoseala.", "Siguranta circuitului este de 16 A si nu de 25 A.", "Siguranta de 16 A protejeaza prizele."]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "evidence_id long, content string")


#: Ways in which a free answer names its letter, and two that name none.
ANSWERS = ("Raspuns corect: B", "Varianta c este cea corecta", "a) 30 mm", "**A**", "Nu stiu", "The answer is (b).")

#: How a free answer names a letter, in the order tried.
ANSWER_RULES = (
    r"(?i)(?:raspuns|răspuns|answer)[^a-dA-D\n]{0,20}?(?:corect|is)?\s*[:\-]?\s*\(?([a-d])\b",
    r"(?i)variant[ae]\s+\(?([a-d])\b",
    r"^\s*\*{0,2}\(?([a-dA-D])\s*[).:*]",
    r"(?i)\(([a-d])\)",
)


def sample_answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ANSWERS)), "answer_id long, answer string")


def as_text() -> Column:
    """A question with its options as one text."""
    return F.concat_ws("\n", "question", F.concat(F.lit("a) "), "varianta_a"), F.concat(F.lit("b) "), "varianta_b"), F.concat(F.lit("c) "), "varianta_c"))


def options(questions: DataFrame) -> DataFrame:
    """One row per option: ``question_id, letter, option``."""
    each = F.array(*[F.struct(F.lit(x).alias("letter"), F.col(f"varianta_{x}").alias("option")) for x in "abc"])
    return questions.select("question_id", F.explode(each).alias("o")).select("question_id", "o.letter", "o.option")


def option_text(text: Column, letter: str) -> Column:
    """What stands behind a letter, up to the next option or the end; null without it."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?is)(?:^|[\n\s])[{letter}{letter.upper()}]\s*[).:]\s*(.*?)(?=(?:[\n\s][a-dA-D]\s*[).:])|$)", 1)), F.lit(""))


def detect(texts: DataFrame) -> DataFrame:
    """Is a text a quiz?  A quarter for each of the options a to c and for a parse, a tenth for key words and a question's ending."""
    t = F.col("text")
    parts = {x: option_text(t, x) for x in "abc"}
    all_three = parts["a"].isNotNull() & parts["b"].isNotNull() & parts["c"].isNotNull()
    score = sum((F.when(p.isNotNull(), 0.25).otherwise(0.0) for p in parts.values()), F.lit(0.0)) + F.when(all_three, 0.25).otherwise(0.0)
    stem = F.trim(F.regexp_extract(t, r"(?is)^(.*?)(?:[\n\s][aA]\s*[).:]|$)", 1))
    score = score + F.when(F.lower(stem).rlike("care|ce |which|what|unde|cum"), 0.1).otherwise(0.0) + F.when(stem.rlike("[?:]$"), 0.1).otherwise(0.0)
    return texts.select("question_id", stem.alias("stem"), *[p.alias(f"option_{x}") for x, p in parts.items()], F.round(score, 2).alias("score"), ((score >= 0.75) & all_three).alias("is_quiz"))


def numeric_answers(questions: DataFrame, evidence: DataFrame, near: float = 0.1) -> DataFrame:
    """The option whose number, with its unit, the evidence has most often; the first of equals.

    A join on the unit, not of all pairs; options without a number do not take part.
    """
    own = options(questions).withColumn("m", F.try_element_at(measurements(F.col("option")), F.lit(1))).where("m is not null")
    own = own.select("question_id", "letter", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))
    seen = evidence.select("evidence_id", F.explode(measurements(F.col("content"))).alias("e")).select("evidence_id", F.col("e.value").alias("seen"), F.col("e.unit").alias("unit"))
    # numbers are counted before the join, so a common unit costs its different values only
    seen = seen.groupBy("unit", "seen").agg(F.count("*").alias("times"))
    hits = own.join(seen, "unit", "left").groupBy("question_id", "letter").agg(F.coalesce(F.sum(F.when(F.abs(F.col("value") - F.col("seen")) < near, F.col("times"))), F.lit(0)).alias("hits"))
    w = Window.partitionBy("question_id").orderBy(F.desc("hits"), "letter")
    best = hits.withColumns({"n": F.row_number().over(w), "margin": F.col("hits") - F.coalesce(F.lead("hits").over(w), F.lit(0))}).where("n = 1")
    return best.select("question_id", F.when(F.col("hits") > 0, F.col("letter")).alias("letter"), "hits", "margin")


def parse_answers(answers: DataFrame) -> DataFrame:
    """The letter that a free answer names, by the first rule that finds one."""
    found = F.coalesce(*[F.nullif(F.lower(F.regexp_extract("answer", rule, 1)), F.lit("")) for rule in ANSWER_RULES])
    return answers.select("answer_id", found.alias("letter"))


#: Terms of quiz options by category. Fixed values.
CATEGORIES = (
    ("zone", ("zona protectie", "zona siguranta", "protectie", "siguranta")),
    ("pt", ("post transformare", "post de transformare", "pt ", "statie")),
    ("lea", ("linie electrica", "lea", "linie aeriana", "conductoare", "conductor")),
    ("izolatie", ("rezistenta izolatie", "rezistenta de izolatie", "megaohm", "mohm", "mω")),
    ("impamantare", ("impamantare", "legare la pamant", "priza de pamant", "electrod")),
    ("paratrasnet", ("paratrasnet", "trasnet", "descarcare atmosferica")),
    ("supratensiune", ("supratensiune", "protectie supratensiune", "descarcator")),
    ("ddr", ("ddr", "dispozitiv diferential", "protectie diferentiala", "30ma", "30 ma")),
    ("scurtcircuit", ("curent de scurtcircuit", "scurtcircuit", "ik", "current de defect")),
    ("conductoare", ("conductor", "cabluri", "conductoare", "faza", "nul")),
    ("tablou", ("tablou", "tablou electric", "tablou distributie")),
    ("siguranta", ("siguranta", "siguranta automata", "disjunctor", "intrerupator")),
    ("priza", ("priza", "prize", "circuit priza")),
    ("material", ("cupru", "aluminiu", "al-ol", "cupal", "sectiune")),
    ("sectiune", ("mm2", "mm²", "diametru", "latime", "lungime")),
    ("dimensiuni", ("distanta", "inaltime", "adancime", "verticala", "orizontala")),
    ("instalatie", ("instalatie interioara", "instalatie electrica", "circuite")),
    ("iluminat", ("iluminat", "corp de iluminat", "lampa", "temperatura")),
    ("incendiu", ("incendiu", "foc", "praf", "fibre")),
    ("funda", ("funda", "fundatie", "beton", "armatura")),
    ("orientare", ("vertical", "orizontal", "inclinat")),
    ("izolator", ("izolator", "izolatoare", "tija", "capa")),
    ("protectie", ("limitare", "accident", "terti", "persoane")),
    ("siguranta", ("vecinatate", "pericol", "exploatare", "functionare")),
    ("acces", ("circulatie", "acces", "securitate", "interzis")),
)

#: Words of five letters or more that count by themselves. Fixed values.
SIGNIFICANT = (
    *("protectie", "siguranta", "limitare", "accident", "terti", "vecinatate", "pericol", "exploatare", "circulatie"),
    *("securitate", "post", "transformare", "vertical", "orizontal", "impamantare", "izolatie", "conductoare", "supratensiune"),
)


def keywords(text: Column) -> Column:
    """Terms of all categories that a text holds, accents aside, as ``category:term``, and its significant words as ``word:...``."""

    def found(plain: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(t)), F.lit(f"{c}:{t}")) for c, terms in CATEGORIES for t in terms]))
        words = F.filter(F.split(plain, r"\s+"), lambda w: (F.char_length(w) >= 5) & w.isin(*SIGNIFICANT))
        return F.array_distinct(F.concat(named, F.transform(words, lambda w: F.concat(F.lit("word:"), w))))

    return let(strip_accents(F.lower(text)), found)
