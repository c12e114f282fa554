"""The pipeline's stages keep clean documents and drop what each is for."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = "Seven wizards counted the golden apples while nobody in the quiet village was looking at them."
    clean = [prose(rng, 80) for _ in range(400)]
    data = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    bad = [(1000 + i, f"{prose(rng, 40)} idiot {prose(rng, 40)}", "en", "s1") for i in range(150)]
    copies = [(2000 + i, clean[i].replace(" ", "  ", 3), "en", "s2") for i in range(5)]
    near = [(3000 + i, clean[10 + i] + " tail", "en", "s0") for i in range(5)]
    leaks = [(4000 + i, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "en", "s1") for i in range(5)]
    others = [(*r, len(r[1])) for r in (*bad, *copies, *near, *leaks)]
    spark.createDataFrame([*data, *others], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(1000 + i, 1, 1) for i in range(0, 150, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus).persist()
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "source_mix":
            assert sorted(docs.columns) == sorted(COLUMNS)
    clean = set(range(400))
    assert len(kept["quality"]) < before and len(clean - kept["quality"]) <= 8
    assert sum(1000 <= i < 1150 for i in kept["quality"]) <= 15
    # the longer original stays, so the copy with more spaces is kept and the other goes
    assert sum(i in kept["exact_copies"] for i in range(5)) + sum(2000 + i in kept["exact_copies"] for i in range(5)) <= 5
    assert not any(3000 + i in kept["near_copies"] and 10 + i in kept["near_copies"] for i in range(5))
    assert any(4000 <= i < 4005 for i in kept["near_copies"]) and not any(4000 <= i < 4005 for i in kept["benchmark_leaks"])
    assert len(clean & kept["benchmark_leaks"]) >= 385
    assert docs.where("taken > 3 * size or taken <= 0").count() == 0


def test_run_is_the_stages_in_order(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "size", "taken"} <= set(out.columns) and out.count() > 100
    assert out.groupBy("source").agg(F.sum("taken")).count() == 3


def test_stages_on_repeated_and_missing_ids(spark, corpus, tmp_path):
    rng = random.Random(6)
    text = prose(rng, 60)
    near = " ".join([*text.split()[:-1], "tail"])
    item = "Seven wizards counted the golden apples while nobody in the quiet village was looking at them."
    rows = [(1, text), (1, text), (1, text), (1, prose(rng, 50)), (None, text + " "), (None, prose(rng, 50)), (2, near), (2, item), (2, prose(rng, 40)), (None, item), (3, None), (3, ""), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))

    def ids(stage):
        out = dict(corpus_pipeline.STAGES)[stage](spark, df, corpus)
        assert out.columns == df.columns
        return sorted((str(r["doc_id"]), (r["text"] or "").strip()[-20:]) for r in out.select("doc_id", "text").collect())

    tail = lambda n: (rows[n][1] or "").strip()[-20:]
    # the longest of the equal texts is the one with a space more
    assert ids("exact_copies") == sorted([("None", tail(0)), ("1", tail(3)), ("None", tail(5)), ("2", tail(6)), ("2", tail(7)), ("2", tail(8)), ("3", "")])
    assert ids("near_copies") == sorted([("1", tail(0)), ("1", tail(3)), ("None", tail(5)), ("2", tail(7)), ("2", tail(8)), ("3", ""), ("3", ""), ("4", "")])
    assert ids("benchmark_leaks") == sorted((str(i), (t or "").strip()[-20:]) for i, t in rows if t != item)
    assert len(ids("quality")) >= 10
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), corpus).count() == 0, name
