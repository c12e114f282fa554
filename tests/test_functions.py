"""Text, similarity, numeric, confidence and vector functions on hand-computed rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docengine.functions import confidence, numeric, similarity, text, vector


def one(spark, value, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(value.alias("v")).first()["v"]


def test_normalize_and_keywords(spark):
    assert one(spark, text.normalize_query(F.col("t")), t='Ce "este" [DDR]-ul?') == "ce este ddr ul"
    assert one(spark, text.keywords(F.col("t")), t="Ce este o priză, the socket of it?") == ["este", "priză", "socket"]
    assert one(spark, text.search_terms(F.col("t")), t="Unde montez priza în baie?") == ["unde", "montez", "priza", "baie"]
    assert one(spark, text.article_references(F.col("t")), t="conform art. 5.2 și articol 7") == ["5.2", "7"]


@pytest.mark.parametrize(
    ("question", "intent"),
    [("Ce trebuie să fac pentru împământare?", "obligation"), ("Ce este interzis în instalațiile electrice?", "prohibition"), ("Ce inseamna protectie la electrocutare?", "definition"), ("Cum se monteaza?", "procedure"), ("Priza", "general")],
)
def test_query_intent(spark, question, intent):
    assert one(spark, text.query_intent(F.col("t")), t=question) == intent


def test_whole_words_next_to_accents(spark):
    assert one(spark, F.col("t").rlike(text.whole_word(["trebuie"])), t="ștrebuieș") is True
    assert one(spark, F.col("t").rlike(text.whole_word(["trebuie"])), t="xtrebuie") is False


def test_cleanups(spark):
    assert one(spark, text.join_hyphens(F.col("t")), t="conduc-\n  tor") == "conductor"
    assert one(spark, text.decode_entities(F.col("t")), t="a &lt;b&gt; &amp;lt;") == "a <b> &lt;"
    assert one(spark, text.highlight(F.col("t"), F.lit("a.b")), t="A.b axb") == "<mark>A.b</mark> axb"
    assert one(spark, text.js_round(F.lit(-2.5))) == -2


@pytest.mark.parametrize(
    ("source", "cited", "method", "confidence_"),
    [
        ("Se interzice utilizarea conductoarelor neizolate.", "Se interzice utilizarea conductoarelor neizolate.", "EXACT_MATCH", 100),
        ("Se interzice utilizarea conductoarelor.", "SE INTERZICE utilizarea conductoarelor.", "NORMALIZED_MATCH", 98),
        ("unu doi trei patru cinci sase sapte opt noua zece", "unu doi trei patru cinci sase sapte opt noua", "SUBSET_MATCH", 99),
        ("unu doi trei patru cinci sase sapte opt noua zece", "unu doi", "SUBSET_MATCH", 14),
        ("conductoarele se monteaza ingropat in tencuiala", "conductoarele se monteaza ingropat im tencuiala", "LEVENSHTEIN_SIMILAR", 95),
        ("abc", "xyz", "VALIDATION_FAILED", 0),
    ],
)
def test_citation_ladder(spark, source, cited, method, confidence_):
    row = similarity.validate(spark.createDataFrame([(source, cited)], "a string, b string"), "a", "b").first()
    assert row["method"] == method
    if method != "LEVENSHTEIN_SIMILAR":
        assert row["confidence"] == confidence_
    else:
        assert row["confidence"] >= confidence_


def test_edit_similarity_of_empty_texts(spark):
    assert one(spark, similarity.edit_similarity(F.col("a"), F.col("b")), a="", b="") == 1
    assert one(spark, similarity.edit_similarity(F.col("a"), F.col("b")), a="text", b="") == 0


def test_edit_similarity_beyond_the_bands(spark):
    rows = [("kitten" * 4, "sitting" * 4), ("abcdef" * 10, "abcdef" * 9 + "x"), ("a" * 40, "b" * 40), ("abc" * 30, "abc" * 30 + "d")]
    df = spark.createDataFrame(rows, "a string, b string")
    both = df.select(similarity.edit_similarity(F.col("a"), F.col("b")).alias("x"), (1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).alias("y")).collect()
    assert [r["x"] for r in both] == [r["y"] for r in both]


def test_contexts_of_neighbouring_measurements(spark):
    found = one(spark, numeric.measurements(F.col("t"), contexts=True, around=6), t="x 10 mm and 20 mm or 30 mm")
    assert [(m["value"], m["context"]) for m in found if m["unit"] == "mm"] == [(10.0, "x 10 mm and 2"), (20.0, "m and 20 mm or 30"), (30.0, "mm or 30 mm")]


def test_numeric_questions(spark):
    row = one(spark, numeric.numeric_question(F.col("t")), t="minim 30 mm")
    assert (row["minimum"], row["unit"], row["tolerance"]) == (30, "mm", 5)
    row = one(spark, numeric.numeric_question(F.col("t")), t="intre 10 si 20 cm")
    assert (row["minimum"], row["maximum"], row["tolerance"]) == (10, 20, 0)
    assert one(spark, numeric.numeric_question(F.col("t")), t="fara numere") is None
    found = one(spark, numeric.measurements(F.col("t")), t="cablu 2,5 mm si priza IP 44, 16 A")
    assert {(m["value"], m["unit"]) for m in found} >= {(2.5, "mm"), (44.0, "IP"), (16.0, "A")}


def test_match_score(spark):
    q = numeric.numeric_question(F.lit("30 mm"))
    assert one(spark, numeric.match_score(F.lit(30.0), F.lit("mm"), q)) == 80
    assert one(spark, numeric.match_score(F.lit(100.0), F.lit("mm"), q)) == 30


def test_coverage_and_concepts(spark):
    assert one(spark, confidence.coverage(F.lit("priza montare baie"), F.array(F.lit("o priza in baie")))) == pytest.approx(2 / 3)
    assert one(spark, confidence.coverage(F.lit("a b"), F.array(F.lit("x")))) == 0.5
    assert one(spark, confidence.semantic_match(F.lit("priza"), F.array(F.lit("priza")))) == 1.0
    assert one(spark, confidence.semantic_match(F.lit("ddr"), F.array(F.lit("nimic")))) == pytest.approx(0.35)


def vec(values):
    return F.array(*[F.lit(float(x)) for x in values])


def test_vector_edges(spark):
    assert one(spark, vector.cosine(vec([1, 0]), vec([0, 1]))) == 0
    assert one(spark, vector.cosine(vec([0, 0]), vec([1, 1]))) == 0
    assert one(spark, vector.cosine(vec([1, 0]), vec([1, 1]))) == pytest.approx(2**-0.5)
    assert one(spark, vector.euclidean(vec([1, 0]), vec([0, 1]))) == pytest.approx(2**0.5)
    assert one(spark, vector.l2_normalize(vec([0, 0]))) == [0, 0]
    with pytest.raises(PySparkException):
        one(spark, vector.cosine(vec([1]), vec([1, 2])))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10)), min_size=1, max_size=6))
def test_cosine_is_symmetric_and_bounded(spark, pairs):
    a, b = vec([x for x, _ in pairs]), vec([y for _, y in pairs])
    x, y = one(spark, vector.cosine(a, b)), one(spark, vector.cosine(b, a))
    assert x == pytest.approx(y) and -1.000001 <= x <= 1.000001


def test_hash_embedding_has_unit_length(spark):
    df = spark.createDataFrame([("priză priză tablou",), ("",), (None,)], "t string").select(vector.hash_embedding(32)("t").alias("v"))
    sizes = [sum(x * x for x in r["v"]) for r in df.collect()]
    assert sizes[0] == pytest.approx(1) and sizes[1:] == [0, 0]
