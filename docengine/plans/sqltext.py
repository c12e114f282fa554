"""Text functions as DuckDB expressions, for the SQL of the queries."""

from __future__ import annotations

from docengine.functions import lexicon
from docengine.plans.registry import sql_list


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def normalized(x: str) -> str:
    """``similarity.normalize_citation``; word boundaries are ASCII in both engines' patterns."""
    dropped = "|".join(sorted(lexicon.DROPPED, key=len, reverse=True))
    low = f"translate(lower({x}), 'ăâîșşțţ', 'aaisstt')"
    low = rf"""regexp_replace(regexp_replace({low}, '[.,;:!?()"''\-\[\]{{}}]', ' ', 'g'), '\s+', ' ', 'g')"""
    return rf"trim(regexp_replace({low}, '\b(?:{dropped})\b', '', 'g'), ' ')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def key_terms(x: str) -> str:
    """``similarity.key_terms``."""
    return f"list_sort(list_filter({words(f'lower({x})')}, lambda w: length(w) > 3 and not list_contains({sql_list(lexicon.KEY_TERM_STOP)}, w)))"


def contains_any(x: str, terms) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {sql_text(t)})" for t in terms) + ")"


def count_of(x: str, terms) -> str:
    return "(" + " + ".join(f"cast(contains({x}, {sql_text(t)}) as int)" for t in terms) + ")"


def related_concepts(q: str, c: str) -> str:
    """``similarity.related_concepts``."""
    parts = []
    for group in lexicon.RELATED:
        x, y = count_of(q, group), count_of(c, group)
        parts.append(f"case when {x} > 0 and {y} > 0 then least({x}, {y}) / greatest({x}, {y}) else 0 end")
    return f"greatest(0.0, {', '.join(parts)})"


def jaccard(a: str, b: str) -> str:
    x, y = (f"list_distinct({words(f'lower({t})')})" for t in (a, b))
    return f"(case when len(list_distinct(list_concat({x}, {y}))) = 0 then 0 else len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) end)"


def one_byte(x: str) -> str:
    """Lower-case text with one byte for each character, as the edit distance there counts bytes."""
    accented = "éèêëàùûüçôöïäßñáíóúœæ"
    return f"regexp_replace(translate({x}, '{accented}', '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(accented)]}'), '[^\\x00-\\x7F]', '?', 'g')"


def rounded(x: str) -> str:
    """``text.js_round``."""
    return f"cast(floor({x} + 0.5) as bigint)"


def ladder(s: str, c: str, a: str, b: str) -> dict[str, str]:
    """``similarity.validate`` over trimmed (``s, c``) and normalised (``a, b``) columns."""
    ratio = f"(case when length({a}) = 0 then 0 else length({b}) / length({a}) end)"
    edits = f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({one_byte(a)}, {one_byte(b)}) / greatest(length({a}), length({b})) end)"
    same = jaccard(s, c)
    rungs = [
        (f"{s} = {c}", "EXACT_MATCH", "100", "true"),
        (f"{a} = {b}", "NORMALIZED_MATCH", "98", "true"),
        (f"contains({a}, {b}) and {ratio} >= 0.8", "SUBSET_MATCH", rounded(f"90 + {ratio} * 10"), "true"),
        (f"contains({a}, {b})", "SUBSET_MATCH", rounded(f"{ratio} * 100"), "false"),
        (f"{edits} >= 0.95", "LEVENSHTEIN_SIMILAR", rounded(f"{edits} * 100"), "true"),
        (f"{same} >= 0.9", "SEMANTIC_SIMILAR", rounded(f"{same} * 100"), "true"),
    ]
    rungs = [(fits, f"'{name}'", sure, ok) for fits, name, sure, ok in rungs]
    say = lambda k, last: "case " + " ".join(f"when {r[0]} then {r[k]}" for r in rungs) + f" else {last} end"
    return {"method": say(1, "'VALIDATION_FAILED'"), "confidence": say(2, rounded(f"{edits} * 100")), "is_valid": say(3, "false")}
