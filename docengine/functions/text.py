"""Text functions as Column expressions.

Word boundaries are ASCII and stated as look-arounds, because the engine's
``\\b`` takes accented letters for word characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import lexicon

_PUNCTUATION = r"""[.,;:!?()"'\-\[\]]"""


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_ci(text: Column, term: Column | str) -> Column:
    """Case-insensitive substring test; the term is literal."""
    return F.contains(F.lower(text), F.lower(term if isinstance(term, Column) else F.lit(term)))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Does the lower-cased text hold one of the (lower-case) terms?"""
    low = F.lower(text)
    return any_of(F.contains(low, F.lit(t)) for t in terms)


def whole_word(terms: Sequence[str]) -> str:
    """A pattern for one of the terms between ASCII word boundaries."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"


def running_sums(sizes: Column) -> Column:
    """Sums up to each element of an array, its own included, by doubling: after step k each holds the sum of up to 2**k elements."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(2)))).cast("int"))
    step = lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(steps, sizes, step)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often a function of higher order asks for it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def js_round(x: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def normalize_query(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _PUNCTUATION, " "), r"\s+", " "))


def words_of(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def keywords(text: Column, stop: Sequence[str] = tuple(lexicon.QUERY_STOP), longer_than: int = 2) -> Column:
    """Words of the normalised text that are long enough and no stop words; repeats stay."""
    banned = F.array(*[F.lit(w) for w in stop])
    return F.filter(words_of(normalize_query(text)), lambda w: (F.char_length(w) > longer_than) & ~F.array_contains(banned, w))


def search_terms(text: Column, longer_than: int = 3, most: int = 5) -> Column:
    """Terms of a keyword search: non-word characters to spaces, long words, the first few."""
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\săîâșț]", " ")
    return F.slice(F.filter(words_of(plain), lambda w: F.char_length(w) > longer_than), 1, most)


def document_keywords(text: Column, most: int = 10) -> Column:
    """Up to ``most`` words longer than four characters, stop words left out; repeats stay."""
    stop = F.array(*[F.lit(w) for w in lexicon.DOCUMENT_STOP])
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", "")
    return F.slice(F.filter(words_of(plain), lambda w: (F.char_length(w) > 4) & ~F.array_contains(stop, w)), 1, most)


def first_intent(text: Column, ladder: Sequence[tuple[str, Sequence[str]]], default: str = "general", words: bool = True) -> Column:
    """The first rung of the ladder that the text fits."""
    out = None
    for name, terms in ladder:
        fits = text.rlike(whole_word(terms)) if words else contains_any(text, terms)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(default)


def query_intent(text: Column) -> Column:
    return first_intent(normalize_query(text), lexicon.QUERY_INTENTS)


def article_references(text: Column) -> Column:
    """Numbers of cited articles, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?i)art(?:icol)?\.?\s*(\d+[.\d]*)"), F.lit(1))


def classify(text: Column, obligation: Sequence[str] = lexicon.OBLIGATION, prohibition: Sequence[str] = lexicon.PROHIBITION, definition: Sequence[str] = lexicon.DEFINITION) -> dict[str, Column]:
    """Is the paragraph a requirement, a ban or a definition?"""
    low = F.lower(text)
    return {"is_obligation": low.rlike(whole_word(obligation)), "is_prohibition": low.rlike(whole_word(prohibition)), "is_definition": low.rlike(whole_word(definition))}


def strip_accents(text: Column) -> Column:
    """Romanian and common Western letters without their marks."""
    return F.translate(text, "ăâîșşțţáàäéèêëíìïóòöúùüçñ", "aaissttaaaeeeeiiiooouuucn")


def repair_letters(text: Column) -> Column:
    """Undo the letters that a PDF's fonts commonly break (fixed pairs, in this order)."""
    for bad, good in (("ˇa", "ă"), ("ˆa", "â"), ("ˆı", "î"), ("¸s", "ș"), ("¸t", "ț"), ("ş", "ș"), ("ţ", "ț"), ("Ş", "Ș"), ("Ţ", "Ț"), ("ã", "ă")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def join_hyphens(text: Column) -> Column:
    """Words that a line break cut in two become one."""
    return F.regexp_replace(text, r"([A-Za-z0-9_]+)-\s*\n\s*([A-Za-z0-9_]+)", "$1$2")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode_entities(text: Column) -> Column:
    """The five named XML entities; the ampersand last."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def sentences(text: Column) -> Column:
    """Trimmed sentences, none empty."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def excerpt(text: Column, term: Column, before: int = 200, after: int = 300, without: int = 500) -> Column:
    """The text around the first match, with ellipses where it is cut; else its beginning."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + after - 1, F.char_length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), text.substr(start, stop - start + 1), F.when(stop < F.char_length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.concat(F.left(text, F.lit(without)), F.lit("...")))


def highlight(text: Column, term: Column) -> Column:
    """Mark all matches of the literal term, whatever their case."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)(\Q"), term, F.lit(r"\E)")), F.lit("<mark>$1</mark>"))


def count_matching(text: Column, terms: Column) -> Column:
    """How many of an array's terms the text holds."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
