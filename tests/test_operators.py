"""Operators with state, files and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from docengine.operators import chunking, ops, quiz, tables
from docengine.sources import files, sinks, web
from docengine.sources.tables import page_numbers, paragraphs
from docengine.streaming import events as stream


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_page_numbers_reset(spark):
    df = spark.createDataFrame([(["x" * 2000, "y" * 2000, "z" * 100],)], "p array<string>")
    assert df.select(page_numbers(F.col("p")).alias("n")).first()["n"] == [1, 2, 2]


def test_paragraphs_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short\n" + "a" * 30 + "\n  " + "b" * 21 + "  ")], "doc_id long, text string")
    assert rows(paragraphs(docs)) == [(3, 1, "a" * 30), (3, 2, "b" * 21)]


def test_denied_requests_do_not_count(spark):
    data = [(1, i, t) for i, t in enumerate([0, 10, 20, 61, 62, 75])]
    ev = spark.createDataFrame(data, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r["event_id"]: r["allowed"] for r in ops.admit(ev, most=2, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_cache_without_and_with_refresh(spark):
    ev = spark.createDataFrame([(i, t) for i, t in enumerate([0, 8, 16, 24])], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    plain = {r["event_id"]: r["hit"] for r in ops.cache_hits(ev, F.lit("k"), "ts", ttl=10).collect()}
    fresh = {r["event_id"]: r["hit"] for r in ops.cache_hits(ev, F.lit("k"), "ts", ttl=10, refresh=True).collect()}
    assert plain == {0: False, 1: True, 2: False, 3: True}
    assert fresh == {0: False, 1: True, 2: True, 3: True}


def test_refused_operations_cost_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 6), (1, 1, 1.0, 5), (1, 2, 2.0, 4)], "user_id long, event_id long, t double, cost int")
    assert rows(ops.spend(df, opening=10)) == [(1, 0, True, 4), (1, 1, False, 4), (1, 2, True, 0)]


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(250)))], "doc_id long, text string")
    chunks = chunking.word_chunks(docs, 100, 20).orderBy("chunk_index").collect()
    seen = [w for c in chunks for w in c["content"].removeprefix("[...] ").split()]
    assert set(seen) == {f"w{i}" for i in range(250)} and chunks[0]["word_count"] == 100


@pytest.mark.parametrize("unit", ["sentence", "paragraph"])
def test_folded_chunks_stay_within_bounds(spark, unit):
    docs = spark.createDataFrame([(1, "\n".join("Una frase corta numero %d." % i for i in range(200))), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.folded_chunks(docs, unit, most=300, least=10, overlap=50).collect()
    assert got and all(r["char_count"] <= 300 for r in got) and {r["doc_id"] for r in got} == {1}


def test_tables(spark):
    found = tables.extract(tables.sample_texts(spark))
    # the caption of table 3.2 lies within the five lines of table 3.1
    assert {r["table_number"] for r in found.collect()} == {"Tabelul 3.1", "Tabelul 4.1.2"}
    assert tables.cell(found, "Tabelul 3.1", "16", "Sectiune").first()["value"] == "2.5"
    asked = spark.createDataFrame([(1, "tabelul 3.1")], "query_id long, query string")
    assert tables.search(found, asked).first()["table_number"] == "Tabelul 3.1"
    shown = found.where("table_number = 'Tabelul 3.1'").withColumn("document_name", F.lit("norma")).select(tables.display().alias("m")).first()["m"]
    assert shown.startswith("**Tabelul 3.1**\nSectiunea conductoarelor\n📄 Pagina 12 din norma\n\n| Curent | Sectiune | Material |\n|---|---|---|\n| 10 | 1.5 | cupru |\n")


def test_quiz(spark):
    found = {r["question_id"]: r["letter"] for r in quiz.numeric_answers(quiz.sample_questions(spark), quiz.sample_evidence(spark)).collect()}
    assert found[1] == "b" and found[3] == "b"
    assert [r["letter"] for r in quiz.parse_answers(quiz.sample_answers(spark)).orderBy("answer_id").collect()] == ["b", "c", "a", "a", None, "b"]
    assert all(r["is_quiz"] for r in quiz.detect(quiz.sample_questions(spark).select("question_id", quiz.as_text().alias("text"))).collect())


def test_crawl_meets_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(web.crawl(edges, spark.createDataFrame([("a",)], "node string"), save=lambda df: df.cache())) == [("a", 0), ("b", 1), ("c", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Un paragraf destul de lung cu ă.\n\nAlt paragraf destul de lung.".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "d.exe").write_bytes(b"MZ")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Salut</w:t><w:tab/><w:t>lume</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "f.odt", "w") as z:
        z.writestr("content.xml", '<o xmlns:t="t"><t:p>Unu<t:s t:c="2"/>doi<t:tab/></t:p></o>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert "ă" in got["a.txt"]["text"] and got["a.txt"]["page_count"] == 1
    assert got["b.txt"]["text"] == "café"
    assert "unsupported" in got["d.exe"]["error"] and got["g.docx"]["error"]
    assert got["e.docx"]["text"] == "Salut\tlume" and got["f.odt"]["text"] == "Unu  doi\t"
    assert files.folder_sizes(files.scan(spark, str(tmp_path))).first()["files"] == 6


def test_legal_paragraphs(spark):
    law = "CAPITOLUL I Reguli\n" + "\n".join(f"Art. {i}. Instalatiile electrice se executa de persoane autorizate conform regulii {i}." for i in range(1, 13))
    got = files.legal_paragraphs(spark.createDataFrame([(1, law), (2, None)], "doc_id long, text string")).collect()
    assert len(got) == 12 and got[0]["chapter"].startswith("CAPITOLUL I")


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert rows(sinks.upserted(old, new, "id")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.without(old, new, "id")) == [(1, "a")]


def test_streams(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(f"{sf}/events.parquet", f"{folder}/events.parquet")
    source = lambda: stream.event_stream(spark, folder, batch.schema)
    assert stream.drain(stream.sessions(source()), "t_sessions").count() > 0
    assert stream.drain(stream.windowed_counts(source()), "t_windows").count() > 0
    got = {r["event_id"]: r["allowed"] for r in stream.drain(stream.limited(source(), 2, 3600), "t_limited").collect()}
    want = {r["event_id"]: r["allowed"] for r in ops.admit(batch, 2, 3600).collect()}
    assert got == want
