"""Citation checks: the validation ladder, factual accuracy and relevance."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import lexicon
from docengine.functions.text import js_round, let, words_of


def _by_first_letter(terms: tuple[str, ...]) -> str:
    """The pattern of :func:`whole_word` with its terms under their first letters, longer ones first, which tries few of them at a word."""
    firsts = sorted({t[0] for t in terms})
    groups = [re.escape(c) + "(?:" + "|".join(re.escape(t[1:]) for t in sorted(terms, key=len, reverse=True) if t[0] == c) + ")" for c in firsts]
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(groups)})(?![A-Za-z0-9_])"


_DROPPED = _by_first_letter(tuple(lexicon.DROPPED))


def normalize_citation(text: Column) -> Column:
    """Lower case, no accents, no punctuation, no function words; accents go first so that edits count letters."""
    marks = ".,;:!?()\"'-[]{}"
    low = F.translate(F.lower(text), "ăâîșşțţ" + marks, "aaisstt" + " " * len(marks))
    # white space that is one space already is left alone
    low = F.regexp_replace(low, r"\s{2,}|[^\S ]", " ")
    return F.trim(F.regexp_replace(low, _DROPPED, ""))


def key_terms(text: Column) -> Column:
    """Sorted long words; repeats stay."""
    stop = F.array(*[F.lit(w) for w in lexicon.KEY_TERM_STOP])
    return F.array_sort(F.filter(words_of(F.lower(text)), lambda w: (F.char_length(w) > 3) & ~F.array_contains(stop, w)))


#: Edits within which a distance is looked for, one after the other, before the whole table is filled.
BANDS = (4, 16, 64, 256, 1024)


def _alike(a: Column, b: Column, part: Callable[[Column, Column], Column]) -> Column:
    """The length of the longest equal ``part`` (first or last letters) of two texts, by halving."""
    most = F.least(F.char_length(a), F.char_length(b))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        same = part(a, middle) == part(b, middle)
        return F.struct(F.when(same, middle).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(F.greatest(middle - 1, acc["lo"])).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.alias("hi")), halve, lambda acc: acc["lo"])


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein's distance.

    Equal beginnings and endings are cut off first, which settles texts that are
    cut, lengthened or changed in one place; what is left is looked for within
    ever more edits, at the cost of its length times those.  A difference of the
    lengths bounds the distance from below, so bands that cannot hold it are
    left out.
    """

    def rest(x: Column) -> Column:
        distance = F.levenshtein(x["a"], x["b"])
        apart = F.abs(F.char_length(x["a"]) - F.char_length(x["b"]))
        for most in reversed(BANDS):
            within = F.when(apart <= most, F.levenshtein(x["a"], x["b"], most))
            distance = F.coalesce(F.when(within >= 0, within), distance)
        return F.when((x["a"] == "") | (x["b"] == ""), F.char_length(x["a"]) + F.char_length(x["b"])).otherwise(distance)

    def behind(x: Column) -> Column:
        tail = lambda y: _alike(y["a"], y["b"], F.right)
        cut = lambda y, n: F.left(y, F.char_length(y) - n)
        return let(tail(x), lambda n: let(F.struct(cut(x["a"], n).alias("a"), cut(x["b"], n).alias("b")), rest))

    def both(x: Column) -> Column:
        skip = lambda y, n: F.substr(y, n + 1)
        return let(_alike(x["a"], x["b"], F.left), lambda n: let(F.struct(skip(x["a"], n).alias("a"), skip(x["b"], n).alias("b")), behind))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), both))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - edit_distance(a, b) / longer)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two texts."""
    x, y = F.array_distinct(words_of(F.lower(a))), F.array_distinct(words_of(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def validate(df: DataFrame, source: str, cited: str) -> DataFrame:
    """Adds ``method, confidence, is_valid``, the ladder: exact, normalised, subset, small edits, same words, else invalid.

    The texts are normalised once; edit distance and word overlap are computed
    once, and only for rows that no earlier rung settles.
    """
    df = df.withColumns({"_s": F.trim(source), "_c": F.trim(cited)})
    df = df.withColumns({"_a": normalize_citation(F.col("_s")), "_b": normalize_citation(F.col("_c"))})
    a, b = F.col("_a"), F.col("_b")
    inside = F.contains(a, b)
    df = df.withColumn("_open", ~((F.col("_s") == F.col("_c")) | (a == b) | inside))
    df = df.withColumn("_ratio", F.when(F.char_length(a) == 0, 0.0).otherwise(F.char_length(b) / F.char_length(a)))
    df = df.withColumn("_edits", F.when(F.col("_open"), edit_similarity(a, b)))
    df = df.withColumn("_words", F.when(F.col("_open") & (F.col("_edits") < 0.95), jaccard(F.col("_s"), F.col("_c"))))
    ratio, edits, words = F.col("_ratio"), F.col("_edits"), F.col("_words")
    say = lambda method, confidence, ok: F.struct(F.lit(method).alias("method"), confidence.cast("long").alias("confidence"), F.lit(ok).alias("is_valid"))
    found = (
        F.when(F.col("_s") == F.col("_c"), say("EXACT_MATCH", F.lit(100), True))
        .when(a == b, say("NORMALIZED_MATCH", F.lit(98), True))
        .when(~F.col("_open") & (ratio >= 0.8), say("SUBSET_MATCH", js_round(90 + ratio * 10), True))
        .when(~F.col("_open"), say("SUBSET_MATCH", js_round(ratio * 100), False))
        .when(edits >= 0.95, say("LEVENSHTEIN_SIMILAR", js_round(edits * 100), True))
        .when(words >= 0.9, say("SEMANTIC_SIMILAR", js_round(words * 100), True))
        .otherwise(say("VALIDATION_FAILED", js_round(edits * 100), False))
    )
    df = df.withColumn("_v", found)
    names = ("method", "confidence", "is_valid")
    return df.withColumns({n: F.col(f"_v.{n}") for n in names}).drop("_s", "_c", "_a", "_b", "_open", "_ratio", "_edits", "_words", "_v")


def factual_accuracy(extract_terms: Column, original_terms: Column) -> dict[str, Column]:
    """Compares two lists of key terms both ways; list differences keep repeats.

    Both should be columns of their own, so that they are computed once per row.
    """
    x, y = extract_terms, original_terms
    missing = F.size(F.filter(y, lambda w: ~F.array_contains(x, w)))
    added = F.size(F.filter(x, lambda w: ~F.array_contains(y, w)))
    both = missing + added
    return {
        "missing": missing.cast("long"),
        "added": added.cast("long"),
        "is_valid": (missing <= 2) & (added <= 2),
        "confidence": F.when(both == 0, 100).when((missing > 2) | (added > 2), F.greatest(F.lit(0), 100 - both * 10)).otherwise(90 - both * 5).cast("long"),
    }


def concept_counts(text: Column) -> Column:
    """How many terms of each concept group a normalised text holds."""
    groups = F.array(*[F.array(*[F.lit(t) for t in group]) for group in lexicon.RELATED])
    return F.transform(groups, lambda group: F.size(F.filter(group, lambda t: F.contains(text, t))))


def related_concepts(query: Column, content: Column) -> Column:
    """Best overlap of two texts' concept counts within one group, as the ratio of the smaller count to the larger."""
    overlap = lambda q, c: F.when((q > 0) & (c > 0), F.least(q, c) / F.greatest(q, c)).otherwise(0.0)
    return F.array_max(F.zip_with(query, content, overlap))


def relevance(query: Column, terms: Column, content: Column, query_counts: Column | None = None, content_counts: Column | None = None) -> Column:
    """Share of the query's key terms in the content, related concepts, and a bonus for the whole phrase.

    ``query`` and ``content`` are normalised, ``terms`` are the query's key terms.
    Where texts meet several queries, their concept counts should be columns of
    their own, which are computed once for each text.
    """
    n = F.size(terms)
    either = lambda counts, said: concept_counts(said) if counts is None else counts
    related = related_concepts(either(query_counts, query), either(content_counts, content))
    hit = F.size(F.filter(terms, lambda t: F.contains(content, t)))
    phrase = F.when(F.contains(content, query), 0.3).otherwise(0.0)
    return F.when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), hit / n * 0.7 + related * 0.3 + phrase))
