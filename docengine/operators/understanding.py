"""What a question is about, whether it needs clarifying, and how an answer is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import contains_any, words_of

#: Words that lead a question and are no part of its subject. Fixed values.
LEADING = ("cum", "ce", "cat", "cand", "unde", "de ce", "cine", "care", "se", "sunt", "este", "face", "fac", "realizeaza")

#: What is asked, in the order tried: pattern and name. Fixed values.
ACTIONS = (("cum (se|se face|se realizeaza|fac)", "cum se face"), ("ce (este|sunt|inseamna)", "definitie"), ("cat(e|i|a)?", "valoare/cantitate"), ("unde", "locatie"), ("cand", "timp"), ("de ce", "explicatie"))

#: Facts that a question may state: words and the fact. Fixed values.
FACTS = (("cupru", "cupru"), ("aluminiu", "aluminiu"), ("interior", "instalatii interioare"), ("exterior", "instalatii exterioare"))

#: Concepts whose principles hold whatever the details. Fixed values.
UNIVERSAL = ("selectivitate", "scurtcircuit", "tensiune", "protectie", "normativ")

#: Ambiguous questions: pattern and what is missing. Fixed values.
AMBIGUOUS = (("cat (costa|e|sunt)", "preț/cantitate specifică"), ("ce (model|tip|marcă)", "specificații tehnice detaliate"), ("cum (se monteaza|se instaleaza)", "tip instalație și condiții"))

#: Why a question needs clarifying or not; the first is followed by what is missing. Fixed values.
REASONS = {
    "ambiguous": "Întrebare ambiguă - necesită ",
    "vague": "Întrebare prea vagă",
    "enough": "Am suficiente informații pentru un răspuns util",
    "universal": "Concept universal - principiile sunt aceleași indiferent de detalii",
    "found": "Am găsit informații relevante în documente",
}

#: Categories of file names, in the order tried. Fixed values.
CATEGORIES = (
    (("nte",), "Norme Tehnice ANRE (NTE)"),
    (("pe", "proiect"), "Proiecte de Reglementare (PE)"),
    (("lege",), "Legislație Primară"),
    (("hot", "hg"), "Hotărâri de Guvern"),
    (("ordin", "ord"), "Ordine ANRE"),
    (("regulament",), "Regulamente ANRE"),
    (("decizie",), "Decizii ANRE"),
    (("indrumar", "ghid"), "Ghiduri și Îndrumări"),
)

#: Chunk size, overlap and least size of the document profiles. Fixed values.
PROFILES = (("romanian-legal-norm", 500, 50, 30), ("romanian-law", 600, 100, 40), ("technical-manual", 800, 150, 25), ("generic-document", 1000, 200, 20), ("scanned-pdf", 800, 100, 30))

#: Price in dollars of a million tokens, by embedding model. Fixed values.
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}

#: Words by which a question leans on what was said before. Fixed values.
FOLLOW_UP = ("cum se", "cum", "de ce", "cât", "când", "unde", "acesta", "aceasta", "ei", "ele", "lor", "acest", "selectivitatea", "protectia", "circuitul", "tabloul")


def subject(text: Column) -> Column:
    """The first two long words behind the leading question words."""
    clean = F.lower(text)
    for word in LEADING:
        clean = F.regexp_replace(clean, rf"^{word}\s*", "")
    long = F.filter(words_of(F.regexp_replace(clean, "[?.,!;:]", "")), lambda w: F.char_length(w) > 3)
    return F.when(F.size(long) == 0, "instalatii electrice").otherwise(F.array_join(F.slice(long, 1, 2), " "))


def action(text: Column) -> Column:
    out = F.lit("informatii")
    for pattern, name in reversed(ACTIONS):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def stated_facts(text: Column) -> Column:
    """Numbers with units, materials and kinds of installation."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?i)\d+\s*(?:mm|mm²|A|tablouri|tablou|circuite)"), F.lit(0))
    low = F.lower(text)
    return F.concat(numbers, F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), fact) for w, fact in FACTS])))


def clarification(question: Column, about: Column, best_score: Column) -> Column:
    """Struct of ``needed`` and ``reason``: general questions on universal concepts and good hits need none."""
    low = F.lower(question)
    general = contains_any(about, UNIVERSAL) & low.rlike("cum se|principii|reguli|general")
    say = lambda needed, reason: F.struct(F.lit(needed).alias("needed"), F.lit(reason).alias("reason"))
    out = F.when((F.char_length(question) < 20) & (about == ""), say(True, REASONS["vague"])).otherwise(say(False, REASONS["enough"]))
    for pattern, missing in reversed(AMBIGUOUS):
        out = F.when(low.rlike(pattern), say(True, REASONS["ambiguous"] + missing)).otherwise(out)
    return F.when(general, say(False, REASONS["universal"])).when(F.coalesce(best_score, F.lit(0.0)) > 0.5, say(False, REASONS["found"])).otherwise(out)


def file_category(name: Column) -> Column:
    out = F.lit("Legislație ANRE")
    for words, category in reversed(CATEGORIES):
        out = F.when(contains_any(name, words), category).otherwise(out)
    return out


def best_profile(content: Column, mime: Column) -> Column:
    """The profile of a text: a norm by its terms, articles and chapters, a scan by its type."""
    norm = content.rlike(r"(?i)(?<![A-Za-z0-9_])(trebuie|obligatoriu|conform|normativ|tehnic)(?![A-Za-z0-9_])") & content.rlike(r"Art\.\s*\d+") & content.rlike(r"(?i)CAPITOLUL\s+\d+")
    return F.when(norm, "romanian-legal-norm").when(F.startswith(mime, F.lit("image/")), "scanned-pdf").otherwise("generic-document")


def embedding_cost(texts: Column, mean_chars: Column, model: str) -> dict[str, Column]:
    tokens = F.ceil(texts * mean_chars / 4)
    return {"tokens": tokens.cast("long"), "cost_usd": tokens / 1_000_000 * PRICES.get(model, 0.02)}


def missing_values(expected: Column, content: Column) -> Column:
    """Expected values that the content holds in none of four spellings."""
    low = F.lower(content)
    found = lambda v: F.contains(low, F.lower(v)) | F.contains(low, F.lower(F.regexp_replace(v, "^([^ ]*) ", "$1"))) | F.contains(low, F.lower(F.replace(v, F.lit("ohmi"), F.lit("Ω")))) | F.contains(low, F.lower(F.replace(v, F.lit("Ω"), F.lit("ohmi"))))
    return F.filter(expected, lambda v: ~found(v))


def display_reference(index: Column, document: Column, page: Column, paragraph: Column, article: Column) -> Column:
    """``[1] name, Art. 5`` or, without an article, page and paragraph."""
    place = F.when(article.isNotNull(), F.concat(F.lit(", Art. "), article)).otherwise(F.concat(F.lit(", pag. "), page.cast("string"), F.lit(", parag. "), paragraph.cast("string")))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), document, place)


def citation_gates(confidence: Column) -> dict[str, Column]:
    return {"strict": confidence >= 85, "lax": confidence >= 70, "high": confidence >= 90}


def answer_sections(lines: Column) -> Column:
    """The kind of each line of an answer: title, quote, important or normal."""
    return F.transform(
        lines,
        lambda s: F.when(s.rlike(r"^#+\s|^\*\*[^*]+\*\*:?$"), "title").when(s.rlike(r'^\s*[">„]'), "quote").when(s.rlike(r"(?i)important|atentie|interzis|obligatoriu"), "important").otherwise("normal"),
    )
