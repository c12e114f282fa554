"""Confidence of an answer from the coverage of its question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import lexicon
from docengine.functions.text import contains_any, js_round, words_of


def question_words(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in lexicon.COVERAGE_STOP])
    return F.filter(words_of(F.lower(text)), lambda w: (F.char_length(w) > 3) & ~F.array_contains(stop, w))


def coverage(query: Column, evidence: Column) -> Column:
    """Distinct words of the question that an evidence text (an array of them) holds, over all its words; none: 0.5."""
    words = question_words(query)
    low = F.transform(evidence, lambda e: F.lower(e))
    hit = F.size(F.filter(F.array_distinct(words), lambda w: F.exists(low, lambda e: F.contains(e, w))))
    return F.when(F.size(words) == 0, 0.5).otherwise(hit / F.size(words))


def _holds(terms: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda e: contains_any(e, terms)


def semantic_match(query: Column, evidence: Column) -> Column:
    """Concepts of the question that the evidence shares, each 1, or -0.3 if it does not, scaled to 0..1; no concept: 0.5."""
    n, total = F.lit(0), F.lit(0.0)
    for terms in lexicon.CONCEPTS.values():
        asked = contains_any(query, terms)
        met = F.exists(evidence, _holds(terms))
        n = n + asked.cast("int")
        total = total + F.when(asked & met, 1.0).when(asked, -0.3).otherwise(0.0)
    return F.when(n == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total / n + 1) / 2)))


def scenario(query: Column) -> dict[str, Column]:
    """Is a question about a practical case, and how complex is it?"""
    low = F.lower(query)
    kinds = [contains_any(low, terms).cast("int") for terms in lexicon.SCENARIOS.values()]
    concepts = sum((contains_any(low, terms).cast("int") for terms in lexicon.CONCEPTS.values()), F.lit(0))
    many = concepts > 1
    types = sum(kinds, F.lit(0))
    asks = sum((F.when(F.startswith(low, F.lit(w)) | F.contains(low, F.lit(f" {w} ")), 0.5).otherwise(0.0) for w in lexicon.QUESTION_WORDS), F.lit(0.0))
    complexity = types + F.when(many, concepts).otherwise(0) + asks
    types = types + many.cast("int")
    return {"complexity": complexity.cast("double"), "n_types": types.cast("long"), "is_practical": (complexity >= 2) | (types >= 2)}


def optimized(mean_score: Column, covered: Column, matched: Column, complexity: Column, practical: Column) -> Column:
    """Blend of score, coverage and concepts with small bonuses, at most 100; plain questions keep their score."""
    original = js_round(mean_score * 100)
    bonus = F.when(covered > 0.7, 5).otherwise(0) + F.when(matched > 0.7, 5).otherwise(0) + F.when(complexity > 3, 3).otherwise(0)
    return F.when(practical, F.least(F.lit(100), js_round(original * 0.4 + covered * 30 + matched * 30) + bonus)).otherwise(original)
