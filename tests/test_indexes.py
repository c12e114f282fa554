"""Trigram index, vector cells, pattern automaton, spans and tables against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.functions import spans
from docengine.operators import cells, hybrid, patterns, retrieval, tables, trigrams
from docengine.sources import shared
from docengine.sources.tables import paragraphs


def some_docs(spark):
    rng = random.Random(4)
    words = ["Tablou", "priză", "și", "Ștecher", "ohm", "a𝔸b", "that", "with"]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    rows += [(None, "no id but priză and that is long enough"), (3, "a second row of document three, with priză"), (200, None), (201, ""), (202, "ab")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def canonical(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("chunk", [50, 1 << 21])
def test_index_finds_what_a_scan_finds(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(trigrams, "CHUNK", chunk)
    docs = some_docs(spark)
    trigrams.build(docs, f"file://{tmp_path}/i")
    index = spark.read.schema("gram long, n long, ids array<long>, bucket int").parquet(f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(1, ["priză", "zzz", "that"]), (2, ["ștecher"]), (3, ["𝔸b "]), (4, ["și", "with"]), (5, []), (6, ["nowhere at all"]), (7, ["with", "with"])], "query_id long, terms array<string>")
    want = retrieval.keyword_candidates(paragraphs(docs), queries)
    got = trigrams.keyword_candidates(index, docs, queries)
    assert canonical(got) == canonical(want) and want.count() > 50
    plan = trigrams.keyword_candidates(index, docs, queries.where("query_id <> 4"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # only the folders of the terms' trigrams are read
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_index_is_built_once(spark, monkeypatch):
    built = []
    monkeypatch.setattr(trigrams, "build", lambda docs, path: built.append(path) or spark.range(1).select(F.lit(1).cast("long").alias("gram"), F.lit(1).cast("long").alias("n"), F.array(F.col("id")).alias("ids"), F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(path))
    docs = some_docs(spark)
    assert trigrams.open_index(docs, "some source").count() == trigrams.open_index(docs, "some source").count() == 1
    assert len(built) == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16)) * 4
    x = np.concatenate([middle[i % 12] + rng.normal(size=16) * 0.3 for i in range(600)]).reshape(-1, 16)
    x = np.concatenate([x, np.zeros((3, 16)), np.repeat(x[:1], 200, axis=0)])
    rows = [(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)] + [(9_000, None, 1)]
    return spark.createDataFrame(rows, "point_id long, embedding array<double>, label long").repartition(5)


def test_cells_give_the_exact_best(spark, points, tmp_path):
    found = cells.build(points, f"file://{tmp_path}/c", sample=300)
    queries = points.where("point_id % 40 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    queries = queries.unionByName(spark.createDataFrame([(-1, [0.0] * 16), (-2, [1.0] * 16), (-3, None)], "query_id long, embedding array<double>"))
    alive = points.where("embedding is not null")
    for k, where, least in ((7, None, -1.0), (5, F.col("label") == 2, 0.3), (1000, None, -1.0)):
        given = alive if where is None else alive.where(where)
        want = retrieval.vector_topk(given, queries.where("embedding is not null"), k, least=least)
        assert canonical(cells.topk(found, queries, k, least=least, where=where)) == canonical(want)
    near = points.where("point_id = 77").select(F.col("point_id").alias("query_id"), "embedding")
    assert canonical(cells.topk(found, near, 5)) == canonical(retrieval.vector_topk(alive, near, 5))
    assert sum(found.probed) < len(found.radius) / 2  # the bound leaves most cells out
    assert canonical(cells.topk(found, queries, 7, block=6)) == canonical(cells.topk(found, queries, 7))
    assert cells.topk(found, queries.limit(0), 5).count() == 0


def test_cells_of_no_points(spark, points, tmp_path):
    empty = cells.build(points.limit(0), f"file://{tmp_path}/none")
    queries = points.where("point_id < 3").select(F.col("point_id").alias("query_id"), "embedding")
    assert cells.topk(empty, queries, 3).count() == 0


@pytest.mark.parametrize("block", [2, 50_000])
def test_patterns_in_one_pass(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_PATTERNS", block)
    texts = ["abababa", None, "", "the cat", "aaaa", "ĂÎ ă the the"]
    known = ["aba", "ab", "aa", "the", "ă", "zzz", "", "cat", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2)
    table = spark.createDataFrame([(p,) for p in known], "pattern string")
    count = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = {(k, p): count(t, p) for k, t in enumerate(texts) for p in set(known) if t and p and count(t, p)}
    assert {(r["k"], r["pattern"]): r["times"] for r in patterns.find_patterns(df, F.col("text"), table).collect()} == want
    totals = {r["pattern"]: (r["n_texts"], r["times"]) for r in patterns.count_patterns(df, F.col("text"), table).collect()}
    assert totals == {p: (sum(q == p for _, q in want), sum(n for (_, q), n in want.items() if q == p)) for p in {q for _, q in want}}
    assert patterns.count_patterns(df, F.col("text"), table.limit(0)).count() == 0


def test_first_number_of_the_options(spark):
    said = {1: ("2,5 mm2", "10 A", "4 ohmi"), 2: ("1.5 kV", "16 A/mm²", "3 m"), 3: ("7 mm", "none", None), 4: ("12.0 V", "9 s", "8 sec")}
    options = spark.createDataFrame([(q, x, o) for q, os in said.items() for x, o in zip("abc", os, strict=True)], "question_id long, letter string, option string")
    values = {(r["question_id"], r["letter"]): [] for r in patterns.option_values(options).collect()}
    for r in patterns.option_values(options).orderBy("place").collect():
        values[r["question_id"], r["letter"]].append((r["value"], r["unit"]))
    assert values[1, "a"] == [("2.5", "mm²")] and values[2, "b"] == [("16", "A/mm²"), ("16", "A")] and values[4, "c"] == [("8", "s")]
    answer = lambda *texts: {r["question_id"]: (r["letter"], r["value"], r["unit"], r["confidence"]) for r in patterns.first_numeric_hit(options, spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()}
    assert answer("un cablu de 25 MM²", "sub 4 Ω") == {1: ("a", "2.5", "mm²", 95)}  # the point may be missing
    assert answer("sub 4  Ω", "16 A/mm2 si 16 amperi", "12 V.") == {1: ("c", "4", "Ω", 95), 2: ("b", "16", "A/mm²", 95), 4: ("a", "12.0", "V", 95)}
    assert answer("10 Amperi", "12 vara", "3 metri") == {2: ("c", "3", "m", 95)}
    assert answer(None, "") == {}


def test_spans_by_rule_and_resolved(spark):
    rng = random.Random(6)
    pieces = ["3,5 A/mm²", "16 A", "0.4 kV", "100 kVA", "2 metri", "5m", "7 mm2", "20 grade C", "3 MΩ", "4 ohmi", "12", " si ", ". ", "9 s", "1.5.2 V", "x8 a.", "10 s2", "16 A si 3 A/mm2"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "; "]) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    rows = df.select("text", spans.unit_spans(F.col("text")).alias("all"), spans.resolved(spans.unit_spans(F.col("text"))).alias("own"), spans.quiz_values(F.col("text")).alias("quiz")).collect()
    flags = re.I
    for r in rows:
        want = []
        for k, (unit, p) in enumerate(spans.RULES):
            for m in re.finditer(re.sub(r"^\(\?iu\)", "", p).replace(r"\w", "[A-Za-z0-9_]"), r["text"], flags):
                want.append((m.start(), m.end(), k, unit, float(m[1].replace(",", "."))))
        assert [tuple(s) for s in r["all"]] == want, r["text"]
        kept, end = [], -1
        for s in sorted(want, key=lambda s: (s[0], -s[1], s[2])):
            if s[0] >= end:
                kept.append(s)
                end = s[1]
        assert [tuple(s) for s in r["own"]] == kept
        plain = [(m.start(), float(m[1].replace(",", "."))) for m in re.finditer(spans.QUIZ_UNIT.replace("(?iu)", ""), r["text"], flags)]
        assert [(s["start"], s["value"]) for s in r["quiz"]] == plain


def test_bounds_without_a_unit(spark):
    said = ["Pentru o priza de pamant: cel mult 4 : si cel mult 4,05 ; sau cel mult 10:", "cel mult 4 :", "priza de pamant 4 ohmi, cel mult 4 :", "x" * 120 + " cel mult 3 : " + "y" * 120 + "priza de pamant"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(spans.quiz_values(F.col("t")).alias("v")).collect()
    assert [[(s["value"], s["unit"]) for s in r["v"]] for r in rows] == [[(4.0, "Ω"), (10.0, "Ω")], [], [(4.0, "Ω")], []]


def test_tables_of_classified_lines(spark):
    df = spark.createDataFrame([(1, None), (2, "pag. 7\nTabelul 2.1 - Titlu\n\nCap A   Cap B\nrand 1   2\nRand Mare 3\t4\nfara"), (3, "TABELUL 1.2 t\n" + "x" * 3100 + "\nTabelul 1.3: t\n1   2   3")], "doc_id long, text string")
    got = {(r["doc_id"], r["table_number"]): r for r in tables.extract(df).collect()}
    assert set(got) == {(2, "Tabelul 2.1"), (3, "Tabelul 1.2"), (3, "Tabelul 1.3")}
    one = got[2, "Tabelul 2.1"]
    assert (one["title"], one["page_number"], one["headers"], one["rows"]) == ("Titlu", 7, ["Cap A", "Cap B"], [["rand 1", "2"], ["Rand Mare 3", "4"]])
    assert got[3, "Tabelul 1.2"]["headers"] == ["Coloana 1", "Coloana 2"] and got[3, "Tabelul 1.2"]["rows"] == []
    assert got[3, "Tabelul 1.3"]["headers"] == ["Coloana 1", "Coloana 2", "Coloana 3"] and got[3, "Tabelul 1.3"]["page_number"] == 2
    found = tables.extract(df)
    assert tables.cell(found, "tabelul2.1", "rand mare", "cap b").first()["value"] == "4"
    assert tables.cell(found, "Tabelul 2.1", "rand 1").first()["value"] == "2"
    assert tables.cell(found, "Tabelul 2.1", "rand 1", "none").first()["value"] is None
    asked = spark.createDataFrame([(1, "tabelul 2.1"), (2, "cap rand")], "query_id long, query string")
    assert [(r["query_id"], r["table_number"], r["score"]) for r in tables.search(found, asked).orderBy("query_id", "rank").collect()][:1] == [(1, "Tabelul 2.1", 53)]
    assert tables.search(found, asked).where("query_id = 2").first()["score"] == 10 * 2 + 5 * 2


def test_toggles_and_step_log(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"un tablou electric cu numarul {i}, in care se monteaza\nsi alte randuri de text") for i in range(6)] + [(6, "nothing of the kind is written here at all")], "doc_id long, text string")
    trigrams.build(docs, f"file://{tmp_path}/i")
    index = spark.read.schema("gram long, n long, ids array<long>, bucket int").parquet(f"file://{tmp_path}/i")
    points = spark.createDataFrame([(5, [1.0, 0.1]), (6, [1.0, 0.0]), (0, [0.0, 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "unde este tablou")], "query_id long, text string")
    vectors = spark.createDataFrame([(1, r, [1.0, 0.0]) for r in (1, 2, 3)], "query_id long, rank long, embedding array<double>")
    log = hybrid.StepLog()
    rows = hybrid.search(asked, vectors, points, docs, index, hybrid.Toggles(synonyms=True), log).collect()
    assert log.counts == {"variants": 3, "vector": 2, "keyword": 6, "combined": 7, "cited": 3}
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["citation_index"])] == [6, 5, 0]
    log = hybrid.StepLog()
    rows = hybrid.search(asked, vectors, points, docs, index, hybrid.Toggles(vector=False), log).collect()
    assert log.counts == {"variants": 1, "keyword": 6, "combined": 6, "cited": 3} and {r["score"] for r in rows} == {0.45}
    assert hybrid.search(asked, vectors, points, docs, index, hybrid.Toggles(vector=False, keyword=False), hybrid.StepLog()).count() == 0
