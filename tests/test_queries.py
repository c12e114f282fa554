"""Every query with SQL against DuckDB at the smallest scale; the others run and return rows."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from docengine.plans import ORACLES, QUERIES

spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parent.parent / "tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in compare.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want)


#: What the rows of the queries without SQL must satisfy, as conditions of which none may fail.
INVARIANTS = {
    "cache_ttl_hits": "true",
    "hash_embedding": "norm between 0.99 and 1.01 or norm = 0",
    "index_chunks": "chunk_index >= 0 and char_count = char_length(content)",
    "overlap_chunks": "char_count = char_length(content) and word_count <= char_count",
    "paragraph_chunks": "char_count = char_length(content) and word_count <= char_count",
    "quiz_numeric": "margin >= 0 and hits >= margin and (letter is not null) = (hits > 0)",
    "sentence_chunks": "char_count = char_length(content) and word_count <= char_count",
    "sentence_page_chunks": "page_number >= 1 and chunk_index >= 0",  # a first sentence that is too long leaves an empty chunk
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    out = QUERIES[name](spark, sf).cache()
    assert out.where(f"not coalesce({INVARIANTS.get(name, 'true')}, false)").count() == 0
    again = QUERIES[name](spark, sf)
    assert out.count() == again.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list of pushed filters is cut off
    plan = QUERIES["dynamic_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_comment" not in plan and "o_custkey" not in plan


def test_top_k_keeps_few_rows_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in QUERIES["cosine_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
