"""From a batch of questions to answers: citing, validating, gating, formatting, quizzes and limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import lexicon, numeric, similarity, text
from docengine.operators import patterns, retrieval

#: Stems by which a question asks for bans or duties, without accents. Fixed values.
BAN_STEMS = ("interdicti", "interzis", "obligatii", "obligatoriu")

#: Phrases of a ban that such questions scan for. Fixed values.
BAN_PHRASES = ("nu se admite", "se interzice", "nu se permite", "nu este permis")

#: What is said below an answer: duties and bans, duties, bans, neither. Fixed values.
DISCLAIMERS = (
    "Textul conține atât obligații cât și interdicții legale. Pentru interpretare juridică completă, consultați un expert.",
    "Textul citează obligații legale. Pentru verificarea conformității, consultați un expert în domeniu.",
    "Textul citează interdicții legale. Nerespectarea poate atrage sancțiuni.",
    "Textul este citat ad-literam din documentele sursă.",
)

#: Questions back that a universal concept makes needless. Fixed values.
UNNECESSARY = ("este vorba despre instalații interioare sau", "ce tip de conductor/cablu folosiți", "cupru sau aluminiu", "interior sau exterior", "linii electrice aeriene", "ce tensiune nominală este în cauză")

#: Limits by kind of request: seconds of the window and most requests. Fixed values.
PRESETS = (("api", 60, 60), ("query", 60, 10), ("upload", 3600, 10))


def is_ban_question(question: Column) -> Column:
    return text.strip_accents(F.lower(question)).rlike("|".join(BAN_STEMS))


@dataclass(frozen=True)
class Limits:
    """How much is searched and cited; the wide numbers are for questions about bans and duties."""

    search: int = 10
    wide_search: int = 30
    cited: int = 5
    wide_cited: int = 10
    threshold: float = 0.4
    slack: float = 0.05
    per_phrase: int = 20
    phrase_score: float = 0.45
    phrases: tuple[str, ...] = BAN_PHRASES


def cite(asked: DataFrame, points: DataFrame, paragraphs: DataFrame, names: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The citations of a batch of questions: ``query_id, citation_index, doc_id, document_name, score``.

    ``asked`` is a batch of bounded size: ``query_id, text, embedding, is_ban``.
    Vector hits come first and by score; where a question asks for bans,
    documents with a ban's phrase that are no hit follow.
    """
    most = F.when(F.col("is_ban"), limits.wide_search).otherwise(limits.search)
    flags = F.broadcast(asked.select("query_id", "is_ban"))
    near = retrieval.vector_topk(points.withColumnRenamed("doc_id", "point_id"), asked, limits.wide_search, least=limits.threshold - limits.slack)
    near = near.join(flags, "query_id").where(F.col("rank") <= most).select("query_id", F.col("point_id").alias("doc_id"), "score", F.lit(0).alias("source_rank"))
    low = F.lower("content")
    said = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in limits.phrases]))
    holding = paragraphs.select("doc_id", F.explode(said).alias("phrase")).distinct()
    holding = retrieval.rank_by(holding, ["phrase"], F.col("doc_id"), most=limits.per_phrase).select("doc_id").distinct()
    # at most a few phrases' worth of documents for each question of the batch
    held = holding.join(F.broadcast(asked.where("is_ban").select("query_id"))).join(near.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    held = held.select("query_id", "doc_id", F.lit(limits.phrase_score).alias("score"), F.lit(1).alias("source_rank"))
    found = near.unionByName(held).where(F.col("score") >= limits.threshold)
    ranked = retrieval.rank_by(found, ["query_id"], F.col("source_rank"), F.desc("score"), F.col("doc_id"), name="citation_index", most=limits.wide_cited)
    ranked = ranked.join(flags, "query_id").where(F.col("citation_index") <= F.when(F.col("is_ban"), limits.wide_cited).otherwise(limits.cited))
    named = ranked.join(names.select("doc_id", "document_name"), "doc_id", "left")
    return named.select("query_id", "citation_index", "doc_id", F.coalesce("document_name", F.lit("Unknown")).alias("document_name"), F.round("score", 6).alias("score"))


def gate(asked: DataFrame, cited: DataFrame, least: int = 40) -> DataFrame:
    """Confidence of each question's citations, and whether it must be asked back."""
    intent = text.first_intent(F.col("text"), lexicon.ROUTE_INTENTS, words=False)
    sums = cited.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    out = asked.select("query_id", "is_ban", intent.alias("intent")).join(sums, "query_id", "left")
    out = out.select("query_id", "is_ban", F.coalesce("n", F.lit(0)).alias("n_citations"), F.coalesce(text.js_round(F.col("mean") * 100), F.lit(0)).alias("confidence"), "intent")
    return out.withColumn("needs_clarification", F.col("confidence") < least)


def validate_batch(cited: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Validates citations against the paragraphs that they name; one that names none fails with confidence 0."""
    both = cited.join(paragraphs.select("doc_id", "paragraph_number", "content"), ["doc_id", "paragraph_number"], "left")
    known = F.col("content").isNotNull()
    out = similarity.validate(both, "content", "cited")
    return out.withColumns(
        {
            "method": F.when(known, F.col("method")).otherwise("VALIDATION_FAILED"),
            "confidence": F.when(known, F.col("confidence")).otherwise(F.lit(0).cast("long")),
            "is_valid": known & F.coalesce("is_valid", F.lit(False)),
        }
    )


def blended(confidence: Column, relevance: Column) -> Column:
    """Mean over citations of their confidence and relevance, three to two, in percent."""
    return text.js_round(F.round(F.avg(confidence / 100 * 0.6 + relevance * 0.4) * 100, 6))


def disclaimer(obliges: Column, forbids: Column) -> Column:
    """What is said below an answer whose citations, some of them, oblige or forbid."""
    o, f = F.bool_or(obliges), F.bool_or(forbids)
    return F.when(o & f, DISCLAIMERS[0]).when(o, DISCLAIMERS[1]).when(f, DISCLAIMERS[2]).otherwise(DISCLAIMERS[3])


def mark_synonyms(shown: Column, question: Column, synonyms: dict[str, tuple[str, ...]] = lexicon.SYNONYMS) -> Column:
    """Marks the question's known words and their synonyms in a text."""
    words = F.split(question, r"\s+")

    def marked(term: str, others: tuple[str, ...]) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            out = x
            for t in (term, *others):
                out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_])({t})(?![A-Za-z0-9_])", r"**$1**")
            return F.when(F.array_contains(words, term), out).otherwise(x)

        return one

    for term, others in synonyms.items():
        shown = text.let(shown, marked(term, others))
    return shown


def boosted_by_numbers(score: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), score + total / 100)


def shown_numbers(measured: Column, most: int = 5) -> Column:
    """The first different numbers with units, in bold, one a line."""
    known = F.filter(measured, lambda m: m["value"].isNotNull())
    once = F.array_distinct(F.transform(known, lambda m: F.struct(m["value"].alias("value"), m["unit"].alias("unit"))))
    return F.array_join(F.transform(F.slice(once, 1, most), lambda m: F.concat(F.lit("**"), numeric.shown_number(m["value"]), F.lit(" "), m["unit"], F.lit("**"))), "\n")


def passthrough(body: Column, words: Column, most: int = 300) -> Column:
    """The sentence with the most words of a question, half a point more for a number, first of equals; short texts as they are."""
    # cut behind the marks, which takes one pass; a search for whole sentences would start anew at every letter of an open end
    found = F.filter(F.split(body, r"(?<=[.!?])(?=[^.!?])"), lambda s: s.rlike("^[^.!?]") & s.rlike("[.!?]$"))
    cut = lambda shown, whole: F.concat(F.left(shown, F.lit(most)), F.when(F.char_length(whole) > most, "...").otherwise(""))
    each = F.transform(found, lambda s: F.struct(F.translate(F.lower(s), "ăâîșşțţ", "aaisstt").alias("plain"), s.alias("s")))
    score = lambda x: F.size(F.filter(words, lambda w: F.contains(x["plain"], w))) + F.when(x["plain"].rlike("[0-9]"), 0.5).otherwise(0.0)
    # greatest score, then the earliest
    at = -F.array_max(F.transform(each, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("at"))))["at"]
    best = F.get(found, at)
    return F.when(F.size(found) <= 1, cut(body, body)).otherwise(cut(F.regexp_replace(best, r"^[ \n\t\r]+|[ \n\t\r]+$", ""), best))


def inline_spans(body: Column) -> dict[str, Column]:
    """The spans of a text that are shown in a style of their own, by kind."""
    patterns = {
        "citation": r"(?i)\[\d+\]",
        "measure": r"(?i)\d+(?:[.,]\d+)?\s*(?:mm|cm|kW|%)",
        "obligation": "(?i)" + text.whole_word(("trebuie", "obligatoriu", "must", "shall")),
        "prohibition": "(?i)" + text.whole_word(("interzis", "forbidden")),
    }
    return {name: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for name, p in patterns.items()}


def keyword_percent(answer: Column, expected: tuple[str, ...]) -> Column:
    """Percent of the expected keywords that an answer holds, whole or one of their words."""
    low = F.lower(answer)
    hit = lambda k: text.any_of(F.contains(low, F.lit(p)) for p in (k, *k.split())).cast("int")
    return text.js_round(sum((hit(k) for k in expected), F.lit(0)) * 100 / len(expected))


# ---- quizzes

#: Stated options: question, letter, keywords, number.
OPTIONS = (
    (1, "a", ("that with", "there"), ""),
    (1, "b", ("zzzzzz qqqqqq", "wwwwww"), ""),
    (1, "c", ("nicht",), "30 mm"),
    (2, "a", ("pour dans",), ""),
    (2, "b", ("vvvvvv",), ""),
    (2, "c", ("kkkkkk",), "9999999 mm"),
    (3, "a", ("jjjjjj",), ""),
    (3, "b", ("hhhhhh",), ""),
    (3, "c", ("gggggg",), ""),
)
#: Stated concepts that options restrict to.
RESTRICTED = ((1, "the"), (2, "zzqqzz"), (3, "it"))


def quiz_values_sql() -> str:
    return ", ".join(f"({q}, '{x}', [{', '.join(repr(k) for k in ks)}], '{v}')" for q, x, ks, v in OPTIONS)


def quiz_options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, x, list(ks), v) for q, x, ks, v in OPTIONS], "question_id long, letter string, keywords array<string>, value string")


def restricted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESTRICTED), "option_id long, concept string")


def held_pieces(pieces: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Those pieces that some paragraph holds, case aside; all are looked for in one pass."""
    return patterns.count_patterns(paragraphs, F.lower("content"), pieces.withColumnRenamed("piece", "pattern")).select(F.col("pattern").alias("piece"))


def route_quiz(options: DataFrame, paragraphs: DataFrame, least_margin: float = 2, least_confidence: float = 75) -> DataFrame:
    """The best option of each question: two for a keyword, half for a long part of it, three for a number that the texts hold.

    A lead below ``least_margin`` gives no answer; an answer of less than
    ``least_confidence`` is left to a model.
    """
    parts = F.flatten(F.transform("keywords", lambda k: F.split(k, " ")))
    pieces = options.select(F.explode(F.array_union("keywords", F.concat(parts, F.array("value")))).alias("piece")).where("piece <> ''")
    held = held_pieces(pieces, paragraphs).agg(F.collect_set("piece").alias("held"))  # no more than the options' pieces
    rows = options.join(F.broadcast(held))
    known = lambda x: F.array_contains("held", x)
    whole = F.size(F.filter("keywords", known)) * 2
    part = F.size(F.filter(parts, lambda p: (F.char_length(p) > 4) & known(p))) * 0.5
    number = F.when((F.col("value") != "") & known(F.col("value")), 3).otherwise(0)
    scored = rows.select("question_id", "letter", (whole + part + number).cast("double").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "letter")
    best = scored.withColumns({"n": F.row_number().over(w), "margin": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))}).where("n = 1")
    sure = (F.col("score") > 0) & (F.col("margin") >= least_margin)
    confidence = F.when(sure, F.least(60 + 5 * F.col("margin"), F.lit(90.0))).otherwise(0.0)
    return best.select("question_id", F.when(sure, F.col("letter")).alias("letter"), "score", confidence.alias("confidence"), F.when(confidence >= least_confidence, "keyword").otherwise("ai").alias("method"))


def check_restrictions(options: DataFrame, paragraphs: DataFrame, words: tuple[str, ...] = ("numai", "doar", "exclusiv")) -> DataFrame:
    """Whether some paragraph restricts each option's concept by one of the words: ``option_id, confirmed``."""
    said = options.select("option_id", F.explode(F.array(*[F.concat(F.lit(w + " "), "concept") for w in words])).alias("piece"))
    found = said.join(held_pieces(said.select("piece"), paragraphs), "piece").select("option_id").distinct().withColumn("hit", F.lit(True))
    return options.join(found, "option_id", "left").select("option_id", F.coalesce("hit", F.lit(False)).alias("confirmed"))


# ---- limits and embeddings


def preset_use(events: DataFrame, presets: tuple[tuple[str, int, int], ...] = PRESETS) -> DataFrame:
    """How many users' windows there are under each preset, how many go over it, and the fullest."""
    each = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(s).alias("seconds"), F.lit(m).alias("most")) for n, s, m in presets])
    rows = events.select("user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("at"), F.explode(each).alias("p")).select("user_id", "at", "p.*")
    windows = rows.groupBy("preset", "most", "user_id", F.expr("at div seconds").alias("slot")).agg(F.count("*").alias("n"))
    return windows.groupBy("preset").agg(F.count("*").alias("windows"), F.count_if(F.col("n") > F.col("most")).alias("over_limit"), F.max("n").alias("most_in_window"))


Embed = Callable[[list[str]], list[list[float]]]


def length_embedding(most_chars: int) -> Embed:
    """A stand-in for an embedding service: a vector of lengths; it refuses texts that are too long."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(len(t) > most_chars for t in texts):
            raise ValueError("text too long")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def embed_batches(rows: DataFrame, embed: Embed, most_chars: int | None = None) -> DataFrame:
    """``batch, text`` with ``embedding``; every vector of a batch on which ``embed`` fails is empty.

    ``embed`` may be a client of a service.  Batches must be small: one is one
    call, and is held by one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [" ".join(t.split())[:most_chars] if most_chars else t for t in pdf["text"]]
        try:
            vectors = embed(texts)
        except Exception:  # noqa: BLE001  a failing service must not end the job
            vectors = [[] for _ in texts]
        return pdf.assign(embedding=vectors)

    return rows.groupBy("batch").applyInPandas(run, "batch long, text string, embedding array<double>")


# ---- rendering and guidance

#: Terms of a quiz question that decide its answer. Fixed values.
KEY_TERMS = (
    *("numai", "doar", "exclusiv", "strict", "obligatoriu", "mereu", "totdeauna", "optional", "poate", "se poate", "este permis", "este admis"),
    *("nu", "niciodata", "interzis", "nepermis", "inadmisibil"),
    *("tablou", "general", "borna", "bara", "legare la pamant", "impamantare", "protectie", "ddr", "dispozitiv diferential"),
    *("priza", "circuit", "conductor", "cabluri", "electrod", "priza de pamant", "legare echipotentiala"),
    *("tn-c", "tn-s", "tt", "it"),
    *("baie", "bucatarie", "exterior", "subsol", "pod", "spatiu umed", "spatiu uscat"),
    *("trebuie", "se monteaza", "se instaleaza", "se realizeaza", "se verifica", "se protejeaza"),
)


def key_terms_of(question: Column) -> Column:
    """The key terms that a question holds, accents aside, in the list's order."""
    plain = text.strip_accents(F.lower(question))
    return F.filter(F.array(*[F.lit(t) for t in KEY_TERMS]), lambda t: F.contains(plain, t))


#: What an answer to a practical question should do: always, by installation, by several concepts, by context, by complexity. Fixed values.
GUIDANCE = (
    "This is a practical scenario query. Structure the response to:",
    ("- Identify the installation requirements and conditions", "- Mention specific measurements or values if present"),
    ("- Address each concept mentioned in the query", "- Show how the concepts relate to each other"),
    ("- Note the specific context or conditions mentioned", "- Indicate if the answer depends on specific circumstances"),
    ("- Acknowledge the complexity of the scenario", "- If information is incomplete, state what is covered and what may need additional verification"),
)
DIRECT = "Provide a direct answer based on the citations."


def guidance(question: Column, practical: Column, complexity: Column) -> Column:
    low = F.lower(question)
    concepts = sum((text.contains_any(low, terms).cast("int") for terms in lexicon.CONCEPTS.values()), F.lit(0))
    when = (text.contains_any(low, lexicon.SCENARIOS["installation"]), concepts > 1, text.contains_any(low, lexicon.SCENARIOS["specificContext"]), complexity > 3)
    lines = [F.when(c, F.lit("\n".join(said))) for c, said in zip(when, GUIDANCE[1:], strict=True)]
    return F.when(practical, F.concat_ws("\n", F.lit(GUIDANCE[0]), *lines)).otherwise(DIRECT)


#: How several citations and one are shown, by style: the opening, each citation, the only one. ``{i}``, ``{name}``, ``{ref}`` and ``{text}`` are filled in. Fixed values.
STYLES = {
    "legal": ("Conform prevederilor citate:", '\n[{i}] {ref}: "{text}"', 'Conform {ref}: "{text}"'),
    "technical": ("Referințe identificate:", "\n[{i}] {name}, {ref}\n{text}", "Referință: {ref}\n\n{text}"),
    "conversational": ("Am găsit următoarele informații:", "\n{i}. Conform {name} ({ref}): {text}", "Conform {ref}: {text}"),
    "formal": ("Pe baza documentelor analizate, identificăm următoarele prevederi:", "\n[{i}] {name}, {ref}:\n{text}", 'Conform documentului "{name}" ({ref}):\n\n{text}'),
}
NOTHING_FOUND = "Nu am găsit informații relevante."


def fill(pattern: str, **parts: Column) -> Column:
    """A pattern with ``{name}`` places as one expression."""
    pieces, rest = [], pattern
    while rest:
        at, end = rest.find("{"), rest.find("}")
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[rest[at + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*pieces)


def templated(cited: DataFrame, style: str) -> DataFrame:
    """``query_id, answer`` in a style, from ``query_id, citation_index, document_name, reference, content``."""
    opening, each, only = STYLES[style]
    parts = {"i": F.col("citation_index").cast("string"), "name": F.col("document_name"), "ref": F.col("reference"), "text": F.col("content")}
    rows = cited.select("query_id", F.struct("citation_index", fill(each, **parts).alias("each"), fill(only, **parts).alias("only")).alias("c"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("all"))  # a few citations each
    many = F.concat_ws("\n", F.lit(opening), F.transform("all", lambda c: c["each"]))
    return grouped.select("query_id", F.when(F.size("all") == 1, F.get("all", F.lit(0))["only"]).otherwise(many).alias("answer"))


def numeric_in_context(options: DataFrame, paragraphs: DataFrame, confidence: int = 98) -> DataFrame:
    """The first option of each question whose number, unit and keyword some sentence holds together: ``question_id, letter, confidence``.

    ``options``: ``question_id, letter, value, unit, keyword``.  Sentences are
    searched for all numbers at once and joined with the options of what they hold.
    """
    s = paragraphs.select(F.explode(F.split(F.lower("content"), "[.!?]+")).alias("s"))
    near = patterns.find_patterns(s, F.col("s"), options.select(F.col("value").alias("pattern"))).withColumnRenamed("pattern", "value")
    number = F.concat(F.lit("(^|[^0-9])"), "value", F.lit("([^0-9]|$)"))
    hits = near.join(options, "value").where(F.contains("s", F.col("unit")) & F.contains("s", F.col("keyword")) & F.call_function("rlike", F.col("s"), number))
    first = hits.groupBy("question_id").agg(F.min("letter").alias("letter"))
    return first.withColumn("confidence", F.lit(confidence).cast("long"))
