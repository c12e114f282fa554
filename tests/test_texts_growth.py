"""What a task holds or sends of texts does not follow the size of its batches or its texts."""

import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from docengine.functions import lexicon, similarity, text
from docengine.operators import chunking, trigrams
from docengine.plans import QUERIES


def test_chunks_leave_a_task_piece_by_piece(spark, monkeypatch):
    rows = [(k, f"first line {k}\n" + "word " * 400 + "\nlast") for k in range(50)] + [(None, "no id " * 60), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = [tuple(r) for r in chunking.folded_chunks(df).collect()]
    monkeypatch.setattr(chunking, "HELD_CHARS", 10)
    assert [tuple(r) for r in chunking.folded_chunks(df).collect()] == whole and len(whole) > 50
    assert {r[0] for r in whole} == {*range(50), None}


def test_best_sentences_send_digests_alone(spark, sf):
    plan = QUERIES["best_sentence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    asked = spark.createDataFrame([(1, ["one", "two"]), (2, [])], "query_id long, ws array<string>")
    said = ["Nothing is said in here at all. One and two are said in this one. Two and one once more, later", "Short. no", None, "a sentence with ONE that shares its id"]
    docs = spark.createDataFrame([(k % 3, t) for k, t in enumerate(said)], "doc_id long, text string")
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["sentence_sha"]) for r in chunking.best_sentences(docs, asked).collect()}
    sha = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256)).first()[0]
    assert got.keys() == {(1, 0), (2, 0)}
    assert got[1, 0] == (2, sha("One and two are said in this one")) and got[2, 0][0] == 0


def test_postings_hold_little_more_than_the_different_trigrams():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "low"])
    tracemalloc.start()
    out = list(trigrams._postings(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, texts))  # bytes; every character's own numbers took more than thrice as many
    got = {(g, i) for b in out for g, ids in zip(b.column("gram").to_pylist(), b.column("ids").to_pylist(), strict=True) for i in ids}
    code = lambda t: ord(t[0]) | ord(t[1]) << 21 | ord(t[2]) << 42
    assert got == {(code(t[k : k + 3]), i) for i, t in enumerate(texts) for k in range(len(t) - 2)}


def test_citations_are_normalised_as_before_in_two_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "an", "the", "si", "și", "la", "de", "pe", "inel", "Sau", "ăla", "éla", "_a", "a1", " ", "  ", "\t", "\n", " a ", ".", "(", "]", "'", '"', "-", "{"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(400)] + [None]
    low = F.regexp_replace(F.regexp_replace(F.translate(F.lower("t"), "ăâîșşțţ", "aaisstt"), r"""[.,;:!?()"'\-\[\]{}]""", " "), r"\s+", " ")
    before = F.trim(F.regexp_replace(low, text.whole_word(lexicon.DROPPED), ""))
    new = similarity.normalize_citation(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(before.alias("want"), new.alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    assert len(re.findall("regexp_replace", df.select("got")._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_concepts_of_a_text_are_counted_once_for_all_questions(spark, sf):
    plan = QUERIES["relevance_score"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "c_counts" in below and "electrocutare" in below
    assert "electrocutare" not in plan[: plan.index("Join")]
