"""Answer operators on small stated tables."""

import pytest
from pyspark.sql import functions as F

from docengine.operators import answers, chunking, ops, quiz, retrieval, tables, understanding
from docengine.sources import files, web


@pytest.mark.parametrize(("question", "is_ban"), [("Ce este INTERZIS?", True), ("obligații legale", True), ("Ce sunt obligatiile", True), ("cum se monteaza", False), (None, None)])
def test_ban_questions(spark, question, is_ban):
    assert spark.createDataFrame([(question,)], "q string").select(answers.is_ban_question(F.col("q"))).first()[0] == is_ban


def test_cite_widens_for_bans_and_names_unknown_documents(spark):
    asked = spark.createDataFrame([(1, "x", [1.0, 0.0], False), (2, "interzis", [0.0, 1.0], True)], "query_id long, text string, embedding array<double>, is_ban boolean")
    points = spark.createDataFrame([(i, [1.0, i / 100.0]) for i in range(40)] + [(100 + i, [i / 100.0, 1.0]) for i in range(40)], "doc_id long, embedding array<double>")
    paragraphs = spark.createDataFrame([(500 + i, 1, "Se interzice asta.") for i in range(30)] + [(100, 1, "se interzice si asta")], "doc_id long, paragraph_number long, content string")
    names = spark.createDataFrame([(0, "first")], "doc_id long, document_name string")
    got = answers.cite(asked, points, paragraphs, names).collect()
    plain, wide = ([r for r in got if r["query_id"] == q] for q in (1, 2))
    assert [r["doc_id"] for r in sorted(plain, key=lambda r: r["citation_index"])] == [0, 1, 2, 3, 4]
    assert len(wide) == 10 and {r["doc_id"] for r in wide} == set(range(100, 110))
    assert {r["document_name"] for r in got} == {"first", "Unknown"}
    few = answers.cite(asked, points.where("doc_id in (1, 100, 101)"), paragraphs, names).where("query_id = 2").orderBy("citation_index").collect()
    assert [r["doc_id"] for r in few[:2]] == [100, 101] and [r["doc_id"] for r in few[2:]] == list(range(500, 508)) and few[2]["score"] == 0.45
    gated = {r["query_id"]: r for r in answers.gate(asked.unionByName(asked.selectExpr("3L as query_id", "text", "embedding", "is_ban").limit(1)), answers.cite(asked, points, paragraphs, names)).collect()}
    assert gated[1]["confidence"] == 100 and gated[3]["needs_clarification"] and gated[3]["n_citations"] == 0


def test_batch_validation_of_missing_paragraphs(spark):
    paragraphs = spark.createDataFrame([(1, 1, "Se interzice utilizarea conductoarelor.")], "doc_id long, paragraph_number long, content string")
    cited = spark.createDataFrame([(1, 1, "Se interzice utilizarea conductoarelor."), (1, 9, "Se interzice"), (2, 1, "x")], "doc_id long, paragraph_number long, cited string")
    got = {(r["doc_id"], r["paragraph_number"]): (r["method"], r["confidence"], r["is_valid"]) for r in answers.validate_batch(cited, paragraphs).collect()}
    assert got == {(1, 1): ("EXACT_MATCH", 100, True), (1, 9): ("VALIDATION_FAILED", 0, False), (2, 1): ("VALIDATION_FAILED", 0, False)}


def test_passthrough_keeps_short_texts_and_cuts_long_ones(spark):
    rows = [("One only.",), ("No mark at all",), ("First one. The second has words and 5 numbers! Third?",), ("x" * 400,), ("",)]
    words = F.array(F.lit("words"), F.lit("second"))
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(answers.passthrough(F.col("t"), words)).collect()]
    assert got == ["One only.", "No mark at all", "The second has words and 5 numbers!", "x" * 300 + "...", ""]


def test_quiz_router_needs_a_lead(spark):
    paragraphs = spark.createDataFrame([("alpha beta gamma and 30 mm",), (None,)], "content string")
    rows = [(1, "a", ["alpha beta"], "30 mm"), (1, "b", ["none"], ""), (1, "c", [], ""), (2, "a", ["alpha"], ""), (2, "b", ["gamma"], "")]
    options = spark.createDataFrame(rows, "question_id long, letter string, keywords array<string>, value string")
    got = {r["question_id"]: (r["letter"], r["score"], r["confidence"], r["method"]) for r in answers.route_quiz(options, paragraphs).collect()}
    assert got == {1: ("a", 5.5, 87.5, "keyword"), 2: (None, 2.5, 0.0, "ai")}


def test_failed_embedding_batches_leave_the_others_alone(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "x" * 20), (2, "abc")], "batch long, text string")
    got = {(r["batch"], len(r["embedding"])) for r in answers.embed_batches(rows, answers.length_embedding(10)).collect()}
    assert got == {(1, 0), (2, 2)}


def test_keyed_scan_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.range(50).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), F.lit(1).alias("cost"))
    got = {r["event_id"]: r["balance"] for r in ops.spend(rows, 10).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(0, 50, 2)] == [max(0, 9 - k) for k in range(25)]


def test_numeric_answers_count_all_evidence(spark):
    questions = spark.createDataFrame([(1, "q", "10 mm", "20 mm", "5 A", "b")], "question_id long, question string, varianta_a string, varianta_b string, varianta_c string, correct string")
    evidence = spark.createDataFrame([(i, "are 20 mm si 20 mm si 10 mm") for i in range(3)], "evidence_id long, content string")
    row = quiz.numeric_answers(questions, evidence).first()
    assert (row["letter"], row["hits"], row["margin"]) == ("b", 6, 3)


def test_column_order_and_captions(spark):
    assert [r[0] for r in spark.createDataFrame([("a | b   c | d",), ("a|b",), ("a  b",)], "l string").select(tables.columns_of(F.col("l"))).collect()] == [["a | b", "c | d"], ["a", "b"], ["a", "b"]]
    found = tables.extract(spark.createDataFrame([(1, "TABELUL 2.1 - x\nA\tB\n1\t2\n")], "doc_id long, text string")).collect()
    assert [r["table_number"] for r in found] == ["Tabelul 2.1"]


def test_clarification_reasons(spark):
    row = spark.sql("select 'cum se face selectivitatea' as q, 'selectivitate' as s, cast(null as double) as b").select(understanding.clarification(F.col("q"), F.col("s"), F.col("b")).alias("c")).first()["c"]
    assert (row["needed"], row["reason"]) == (False, understanding.REASONS["universal"])


def test_crawl_paths_and_listings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["path"] for r in web.crawl_paths(edges, seeds, 2).collect()} == {"a": "a", "b": "a > b", "c": "a > b > c"}
    links = spark.createDataFrame([(1, f"http://x/{i}.pdf") for i in range(3)] + [(1, "http://x/y"), (2, "http://x/z.pdf")], "page_id long, url string")
    assert {r["page_id"]: r["is_listing"] for r in web.listings(links).collect()} == {1: True, 2: False}


def test_sentence_chunks_carry_words_and_pages(spark):
    body = " ".join(f"Sentence number {i} says a few words." for i in range(200))
    got = chunking.sentence_page_chunks(spark.createDataFrame([(1, body), (2, None), (3, "Short.")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in got if r["doc_id"] == 1]
    assert all(len(r["content"]) <= 1200 for r in one) and [r["page_number"] for r in one] == sorted(r["page_number"] for r in one) and one[-1]["page_number"] == 3
    assert one[1]["content"].startswith(" ".join(one[0]["content"].split(" ")[-20:])[:30])
    assert [(r["page_number"], r["content"]) for r in got if r["doc_id"] == 3] == [(1, "Short.")] and not any(r["doc_id"] == 2 for r in got)


def test_question_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text('[\n {"id": 1, "question": "a"},\n {"id": 2, "question": "b"}\n]')
    assert [(r["id"], r["question"]) for r in files.question_sets(spark, str(tmp_path)).orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_templates(spark):
    cited = spark.createDataFrame([(1, 1, "n", "Art. 5", "t1"), (2, 1, "n", "r1", "x"), (2, 2, "m", "r2", "y")], "query_id long, citation_index long, document_name string, reference string, content string")
    legal = {r["query_id"]: r["answer"] for r in answers.templated(cited, "legal").collect()}
    assert legal == {1: 'Conform Art. 5: "t1"', 2: 'Conform prevederilor citate:\n\n[1] r1: "x"\n\n[2] r2: "y"'}


def test_queries_in_blocks_give_the_same_rows(spark, monkeypatch):
    points = spark.createDataFrame([(i, [1.0, i / 7.0]) for i in range(30)], "point_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [i / 3.0, 1.0]) for i in range(7)], "query_id long, embedding array<double>")
    whole = sorted(map(tuple, retrieval.vector_topk(points, queries, 3).collect()))
    monkeypatch.setattr(retrieval.in_blocks, "__defaults__", (2,))
    assert sorted(map(tuple, retrieval.vector_topk(points, queries, 3).collect())) == whole
    assert retrieval.vector_topk(points, queries.limit(0), 3).count() == 0
