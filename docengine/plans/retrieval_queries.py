"""Queries of retrieval, vectors, validation and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import confidence, lexicon, numeric, similarity, text, vector
from docengine.operators import cells, retrieval, trigrams
from docengine.plans import sqltext
from docengine.plans.questions import QUESTION_VALUES, questions
from docengine.plans.registry import query, sql_list
from docengine.plans.understanding_queries import SCENARIO_ASKS, SCENARIO_CASES, SCENARIO_CONCEPTS
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table

_TERMS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(q), '[^A-Za-z0-9_\săîâșț]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)[1:5]"
_Q = f"q as (select cast(query_id as bigint) as query_id, q, {_TERMS_SQL} as terms from (values {QUESTION_VALUES}) t(query_id, q))"
_HITS = f"""{_Q}, {PARAGRAPHS_SQL}, h as (
    select query_id, doc_id, paragraph_number, content, q, terms, len(list_filter(terms, lambda t: contains(lower(content), t))) as hits from p, q
), k as (select *, round(hits / len(terms), 6) as score from h where hits > 0)"""


def _queries(spark: SparkSession) -> DataFrame:
    return questions(spark).withColumn("terms", text.search_terms(F.col("text")))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.keyword_candidates(paragraphs(table(spark, sf, "documents")), _queries(spark))
    return found.withColumn("score", F.round("score", 6))


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same paragraphs by the index of trigrams, which all queries of a session share."""
    docs = table(spark, sf, "documents")
    found = trigrams.keyword_candidates(trigrams.open_index(docs, sf), docs, _queries(spark))
    return found.withColumn("score", F.round("score", 6))


def _top(found: DataFrame) -> DataFrame:
    top = retrieval.rank_by(found, ["query_id"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number"), most=10)
    return top.select("query_id", "doc_id", "paragraph_number", "score", "rank")


def _cited(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    names = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"))
    return retrieval.citations(found, names, 5, 0.4).select("query_id", "citation_index", "doc_id", "document_name", "paragraph_number", "score")


def _confidence(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    out = questions(spark).select("query_id").join(_cited(spark, sf, found).select("query_id", "score"), "query_id", "left").groupBy("query_id")
    out = out.agg(F.coalesce(text.js_round(F.avg("score") * 100), F.lit(0)).alias("confidence"), F.count("score").alias("n_citations"))
    return out.withColumn("needs_clarification", F.col("confidence") < 40)


_TOP_SQL = f"""with {_HITS}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as rank from k)
    select query_id, doc_id, paragraph_number, score, rank from r where rank <= 10"""
_CITED_SQL = f"""with {_HITS}, r as (select k.*, d.source as document_name, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as citation_index from k join documents d using (doc_id) where score >= 0.4)
    select query_id, citation_index, doc_id, document_name, paragraph_number, score from r where citation_index <= 5"""
_CONFIDENCE_SQL = f"""with {_HITS}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as n from k where score >= 0.4),
    c as (select q.query_id, cast(coalesce(floor(avg(score) * 100 + 0.5), 0) as bigint) as confidence, count(n) as n_citations from q left join (select * from r where n <= 5) r using (query_id) group by q.query_id)
    select *, confidence < 40 as needs_clarification from c"""


@query("keyword_search_topk", _TOP_SQL)
def keyword_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_candidates(spark, sf))


@query("indexed_search_topk", _TOP_SQL)
def indexed_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_indexed(spark, sf))


@query("citations_with_source", _CITED_SQL)
def citations_with_source(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf, _candidates(spark, sf))


@query("indexed_citations", _CITED_SQL)
def indexed_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf, _indexed(spark, sf))


@query("answer_confidence", _CONFIDENCE_SQL)
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _confidence(spark, sf, _candidates(spark, sf))


@query("indexed_confidence", _CONFIDENCE_SQL)
def indexed_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _confidence(spark, sf, _indexed(spark, sf))


@query(
    "coverage_confidence",
    f"""with {_HITS}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as n from k),
    e as (select query_id, list(lower(content)) as ev from r where n <= 5 group by query_id),
    w as (select q.query_id, list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: length(w) > 3 and not list_contains({sql_list(lexicon.COVERAGE_STOP)}, w)) as ws, coalesce(ev, []) as ev from q left join e using (query_id))
    select query_id, round(case when len(ws) = 0 then 0.5 else len(list_filter(list_distinct(ws), lambda w: len(list_filter(ev, lambda x: contains(x, w))) > 0)) / len(ws) end, 6) as coverage from w""",
)
def coverage_confidence(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieval.rank_by(_candidates(spark, sf), ["query_id"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number"), most=5)
    evidence = top.groupBy("query_id").agg(F.collect_list("content").alias("evidence"))
    rows = questions(spark).join(evidence, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return rows.select("query_id", F.round(confidence.coverage(F.col("text"), F.col("evidence")), 6).alias("coverage"))


def semantic_sql(q: str, held) -> str:
    """``confidence.semantic_match``; ``held`` gives the SQL of whether the evidence holds one of some terms."""
    asked = [sqltext.contains_any(q, terms) for terms in lexicon.CONCEPTS.values()]
    n = " + ".join(f"cast({a} as int)" for a in asked)
    total = " + ".join(f"case when {a} and {held(terms)} then 1.0 when {a} then -0.3 else 0.0 end" for a, terms in zip(asked, lexicon.CONCEPTS.values(), strict=True))
    return f"(case when ({n}) = 0 then 0.5 else greatest(0.0, least(1.0, (({total}) / ({n}) + 1) / 2)) end)"


WORDS_SQL = f"list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: length(w) > 3 and not list_contains({sql_list(lexicon.COVERAGE_STOP)}, w))"


@query(
    "optimized_confidence",
    f"""with {_HITS}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as n from k),
    e as (select query_id, list(lower(content)) as ev, avg(score) as mean from r where n <= 5 group by query_id),
    w as (select q.query_id, q, {WORDS_SQL} as ws, coalesce(ev, []) as ev, coalesce(mean, 0) as mean, lower(q) as t from q left join e using (query_id)),
    c as (
        select *, case when len(ws) = 0 then 0.5 else len(list_filter(list_distinct(ws), lambda w: len(list_filter(ev, lambda x: contains(x, w))) > 0)) / len(ws) end as covered,
               {semantic_sql("q", lambda terms: "(len(list_filter(ev, lambda x: " + sqltext.contains_any("x", terms) + ")) > 0)")} as matched,
               {SCENARIO_CASES} as types, {SCENARIO_CONCEPTS} as concepts, {SCENARIO_ASKS} as asks
        from w
    ), s as (
        select *, cast(types + case when concepts > 1 then concepts else 0 end + asks as double) as complexity, types + case when concepts > 1 then 1 else 0 end as n_types, floor(mean * 100 + 0.5) as original from c
    ) select query_id, round(covered, 6) as coverage, round(matched, 6) as semantic, complexity, complexity >= 2 or n_types >= 2 as is_practical,
             cast(case when complexity >= 2 or n_types >= 2 then least(100, floor(original * 0.4 + covered * 30 + matched * 30 + 0.5) + case when covered > 0.7 then 5 else 0 end + case when matched > 0.7 then 5 else 0 end + case when complexity > 3 then 3 else 0 end) else original end as bigint) as confidence
      from s""",
)
def optimized_confidence(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieval.rank_by(_candidates(spark, sf), ["query_id"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number"), most=5)
    evidence = top.groupBy("query_id").agg(F.collect_list("content").alias("evidence"), F.avg("score").alias("mean"))
    rows = questions(spark).join(evidence, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    case = confidence.scenario(F.col("text"))
    rows = rows.select("query_id", F.coalesce("mean", F.lit(0.0)).alias("mean"), confidence.coverage(F.col("text"), F.col("evidence")).alias("covered"), confidence.semantic_match(F.col("text"), F.col("evidence")).alias("matched"), *[c.alias(n) for n, c in case.items()])
    return rows.select("query_id", F.round("covered", 6).alias("coverage"), F.round("matched", 6).alias("semantic"), "complexity", "is_practical", confidence.optimized(F.col("mean"), F.col("covered"), F.col("matched"), F.col("complexity"), F.col("is_practical")).alias("confidence"))


@query(
    "optimal_citations",
    f"""with {_HITS}, c as (select query_id, doc_id, paragraph_number, score, {WORDS_SQL} as ws, content, q from k),
    s as (select query_id, doc_id, paragraph_number, round(score * 0.5 + case when len(ws) = 0 then 0.5 else len(list_filter(list_distinct(ws), lambda w: contains(lower(content), w))) / len(ws) end * 0.3 + {semantic_sql("q", lambda terms: sqltext.contains_any("content", terms))} * 0.2, 6) as combined from c),
    r as (select *, row_number() over (partition by query_id order by combined desc, doc_id, paragraph_number) as rank from s)
    select * from r where rank <= 5""",
)
def optimal_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = _candidates(spark, sf).join(F.broadcast(questions(spark)), "query_id")
    evidence = F.array("content")
    combined = F.round(F.col("score") * 0.5 + confidence.coverage(F.col("text"), evidence) * 0.3 + confidence.semantic_match(F.col("text"), evidence) * 0.2, 6)
    rows = found.select("query_id", "doc_id", "paragraph_number", combined.alias("combined"))
    return retrieval.rank_by(rows, ["query_id"], F.desc("combined"), F.col("doc_id"), F.col("paragraph_number"), most=5)


@query(
    "legal_boost_rerank",
    f"""with {_HITS}, b as (select query_id, doc_id, paragraph_number,
        round(least(1.0, score * 0.6 + least(0.3, case when regexp_matches(lower(content), '(^|[^A-Za-z0-9_])(that|with)($|[^A-Za-z0-9_])') then 0.2 else 0 end + hits * 0.03)), 6) as boosted from k),
    r as (select *, row_number() over (partition by query_id order by boosted desc, doc_id, paragraph_number) as rank from b)
    select * from r where rank <= 10""",
)
def legal_boost_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = _candidates(spark, sf).join(F.broadcast(_queries(spark).select("query_id", "terms")), "query_id")
    kinds = text.classify(F.col("content"), ("that", "with"), ("from",), ("this",))
    boosted = retrieval.legal_boost(F.col("score") * 0.6, F.col("content"), F.lit("obligation"), F.col("terms"), kinds=kinds)
    rows = found.select("query_id", "doc_id", "paragraph_number", F.round(boosted, 6).alias("boosted"))
    return retrieval.rank_by(rows, ["query_id"], F.desc("boosted"), F.col("doc_id"), F.col("paragraph_number"), most=10)


_BOOSTS_SQL = " + ".join(
    [
        "0.1 * len(list_filter(terms, lambda t: contains(lower(content), t)))",
        "case when contains(lower(q), 'protectie') and contains(lower(content), 'protectie') then 0.15 else 0 end",
        f"case when {sqltext.contains_any('q', ('priza', 'prize'))} and {sqltext.contains_any('content', ('priza', 'prize'))} then 0.2 else 0 end",
        f"case when {sqltext.contains_any('q', ('obligatoriu', 'obligatorii'))} and {sqltext.contains_any('content', ('trebuie', 'obligatoriu'))} then 0.15 else 0 end",
        *[f"case when contains(lower(q), '{t}') or contains(lower(content), '{t}') then 0.1 else 0 end" for t in ("ddr", "diferential", "30 ma", "30ma", "iδn")],
    ]
)


@query(
    "hybrid_boost_rerank",
    f"""with {_HITS}, b as (select *, {_BOOSTS_SQL} as boost from k), s as (select query_id, doc_id, paragraph_number, round(case when boost > 0 then least(1.0, score * 0.5 + least(boost, 0.5)) else score * 0.5 end, 6) as boosted from b),
    r as (select *, row_number() over (partition by query_id order by boosted desc, doc_id, paragraph_number) as rank from s) select * from r where rank <= 10""",
)
def hybrid_boost_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = _candidates(spark, sf).join(F.broadcast(_queries(spark).select("query_id", "text", "terms")), "query_id")
    rows = found.select("query_id", "doc_id", "paragraph_number", F.round(retrieval.hybrid_boost(F.col("score") * 0.5, F.col("text"), F.col("content"), F.col("terms")), 6).alias("boosted"))
    return retrieval.rank_by(rows, ["query_id"], F.desc("boosted"), F.col("doc_id"), F.col("paragraph_number"), most=10)


_PATTERN = "that the"


@query(
    "excerpt_highlight",
    rf"""with {PARAGRAPHS_SQL}, a as (select doc_id, paragraph_number, content, strpos(lower(content), '{_PATTERN}') as hit from p),
    b as (select *, greatest(hit - 200, 1) as s, least(hit + 299, length(content)) as e from a where hit > 0)
    select doc_id, paragraph_number, case when s > 1 then '...' else '' end || substr(content, s, e - s + 1) || case when e < length(content) then '...' else '' end as excerpt,
    sha256(regexp_replace(content, '({_PATTERN})', '<mark>\1</mark>', 'gi')) as marked_sha from b""",
)
def excerpt_highlight(spark: SparkSession, sf: str) -> DataFrame:
    found = paragraphs(table(spark, sf, "documents")).where(text.contains_ci(F.col("content"), _PATTERN))
    return found.select("doc_id", "paragraph_number", text.excerpt(F.col("content"), F.lit(_PATTERN)).alias("excerpt"), F.sha2(text.highlight(F.col("content"), F.lit(_PATTERN)), 256).alias("marked_sha"))


_SPELLINGS = ("that the", "thatthe", "that.the", "tabelul that")


@query(
    "reference_search",
    rf"""with {PARAGRAPHS_SQL}, m as (select doc_id, paragraph_number, content from p where {' or '.join(f"contains(lower(content), '{s}')" for s in _SPELLINGS)}),
    r as (select *, row_number() over (partition by substr(content, 1, 100) order by doc_id, paragraph_number) as n from m)
    select doc_id, paragraph_number, length(content) as char_count from r where n = 1""",
)
def reference_search(spark: SparkSession, sf: str) -> DataFrame:
    found = paragraphs(table(spark, sf, "documents")).where(text.contains_any(F.col("content"), _SPELLINGS))
    once = retrieval.rank_by(found.withColumn("head", F.left("content", F.lit(100))), ["head"], F.col("doc_id"), F.col("paragraph_number"), most=1)
    return once.select("doc_id", "paragraph_number", F.char_length("content").cast("long").alias("char_count"))


@query(
    "advanced_search",
    rf"""with {PARAGRAPHS_SQL}, m as (select doc_id, paragraph_number, content, 0.95 as score, 0 as source_rank from p where contains(lower(content), 'that the')
        union all select doc_id, paragraph_number, content, 0.6, 1 from p where contains(lower(content), 'with')),
    d as (select *, row_number() over (partition by doc_id, substr(content, 1, 50) order by source_rank, paragraph_number) as n from m),
    r as (select doc_id, paragraph_number, round(score, 6) as score, row_number() over (order by score desc, doc_id, paragraph_number) as rank from d where n = 1)
    select * from r where rank <= 15""",
)
def advanced_search(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    exact = p.where(text.contains_any(F.col("content"), ("that the",))).withColumns({"score": F.lit(0.95), "source_rank": F.lit(0)})
    loose = p.where(text.contains_any(F.col("content"), ("with",))).withColumns({"score": F.lit(0.6), "source_rank": F.lit(1)})
    both = exact.unionByName(loose).withColumn("head", F.left("content", F.lit(50)))
    once = retrieval.rank_by(both, ["doc_id", "head"], F.col("source_rank"), F.col("paragraph_number"), most=1)
    top = once.orderBy(F.desc("score"), "doc_id", "paragraph_number").limit(15)
    return retrieval.rank_by(top.withColumn("all", F.lit(1)), ["all"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number")).select("doc_id", "paragraph_number", "score", "rank")


@query(
    "ban_sentences",
    r"""with s as (select doc_id, unnest(list_transform(regexp_split_to_array("text", '[.!?]+'), lambda x: trim(x, ' '))) as sentence, unnest(range(1, len(regexp_split_to_array("text", '[.!?]+')) + 1)) as k from documents),
    m as (select * from s where length(sentence) > 30 and (contains(lower(sentence), 'nicht') or contains(lower(sentence), 'from') or contains(lower(sentence), 'sans'))),
    r as (select *, row_number() over (partition by substr(lower(sentence), 1, 80) order by doc_id, k) as n from m)
    select doc_id, sha256(sentence) as sentence_sha from r where n = 1""",
)
def ban_sentences(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform(F.split("text", r"[.!?]+"), lambda s: F.trim(s))
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("at", "sentence"))
    found = s.where((F.char_length("sentence") > 30) & text.contains_any(F.col("sentence"), ("nicht", "from", "sans")))
    once = retrieval.rank_by(found.withColumn("head", F.left(F.lower("sentence"), F.lit(80))), ["head"], F.col("doc_id"), F.col("at"), most=1)
    return once.select("doc_id", F.sha2("sentence", 256).alias("sentence_sha"))


# ---- vectors: one stated query, the first axis; and every label's own centroid


def _axes(spark: SparkSession, n: int = 8) -> DataFrame:
    """Stated query vectors: the first ``n`` unit vectors of 64 dimensions."""
    return spark.range(n).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("id"), 1.0).otherwise(0.0)).alias("embedding"))


_AXES = "a as (select cast(q as bigint) as query_id, list_transform(range(0, 64), lambda i: case when i = q then 1.0::double else 0.0::double end) as wanted from range(0, 8) t(q))"


@query(
    "cosine_topk",
    f"""with {_AXES}, s as (select query_id, vec_id as point_id, round(list_cosine_similarity(wanted, embedding::double[]), 6) as score from embeddings, a),
    r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s) select * from r where rank <= 10""",
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_topk(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id"), _axes(spark), 10)


@query(
    "euclidean_topk",
    f"""with {_AXES}, s as (select query_id, vec_id as point_id, round(-list_distance(wanted, embedding::double[]), 6) as score from embeddings, a),
    r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s) select * from r where rank <= 10""",
)
def euclidean_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_topk(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id"), _axes(spark), 10, least=-1e9, metric="euclidean")


_OWN = "a as (select vec_id as query_id, embedding::double[] as wanted from embeddings where vec_id % 50 = 0)"


def _own_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The query vectors of the cell searches: every fiftieth point."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _cells(spark: SparkSession, sf: str) -> cells.Cells:
    return cells.open_cells(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id"), sf)


@query(
    "cells_topk",
    f"""with {_OWN}, s as (select query_id, vec_id as point_id, round(list_cosine_similarity(wanted, embedding::double[]), 6) as score from embeddings, a),
    r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s) select * from r where rank <= 10""",
)
def cells_topk(spark: SparkSession, sf: str) -> DataFrame:
    return cells.topk(_cells(spark, sf), _own_vectors(spark, sf), 10)


@query(
    "cells_filtered_topk",
    f"""with {_OWN}, s as (select query_id, vec_id as point_id, round(list_cosine_similarity(wanted, embedding::double[]), 6) as score from embeddings, a where label in (1, 3, 5) and vec_id % 2 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= 0.1) select * from r where rank <= 5""",
)
def cells_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A payload filter and a least score, before the top k."""
    return cells.topk(_cells(spark, sf), _own_vectors(spark, sf), 5, least=0.1, where=F.col("label").isin(1, 3, 5) & (F.col("point_id") % 2 == 0))


@query("l2_normalize", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: abs(x))) / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as l1 from embeddings")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", vector.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@query(
    "multi_vector_merge",
    f"""with {_AXES}, s as (select query_id % 2 as query_id, query_id as variant, vec_id as point_id, round(list_cosine_similarity(wanted, embedding::double[]), 6) as score from embeddings, a),
    t as (select *, row_number() over (partition by variant order by score desc, point_id) as k from s), u as (select * from t where k <= 10),
    d as (select *, row_number() over (partition by query_id, point_id order by variant, score desc) as n from u),
    r as (select query_id, point_id, score, row_number() over (partition by query_id order by score desc, point_id) as rank from d where n = 1) select * from r where rank <= 10""",
)
def multi_vector_merge(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieval.vector_topk(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id"), _axes(spark), 10)
    lists = top.select((F.col("query_id") % 2).alias("query_id"), F.col("query_id").alias("source_rank"), "point_id", "score")
    return retrieval.merge_lists(lists, ["point_id"], 10).select("query_id", "point_id", "score", "rank")


@query(
    "hybrid_fusion",
    f"""with {_AXES}, {_HITS}, v as (select query_id + 1 as query_id, vec_id as doc_id, round(list_cosine_similarity(wanted, embedding::double[]), 6) as score from embeddings, a where query_id < 5),
    vt as (select *, row_number() over (partition by query_id order by score desc, doc_id) as n from v),
    kd as (select query_id, doc_id, 0.45 as score from k group by query_id, doc_id), kt as (select *, row_number() over (partition by query_id order by doc_id) as n from kd),
    u as (select query_id, doc_id, score, 0 as source_rank from vt where n <= 20 union all select query_id, doc_id, score, 1 from kt where n <= 20),
    d as (select *, row_number() over (partition by query_id, doc_id order by source_rank, score desc) as n from u),
    r as (select query_id, doc_id, round(score, 6) as score, source_rank, row_number() over (partition by query_id order by score desc, doc_id) as rank from d where n = 1)
    select query_id, doc_id, score, cast(source_rank as bigint) as source_rank, rank from r where rank <= 10""",
)
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id")
    near = retrieval.vector_topk(points, _axes(spark, 5), 20).select((F.col("query_id") + 1).alias("query_id"), F.col("point_id").alias("doc_id"), "score", F.lit(0).cast("long").alias("source_rank"))
    held = _candidates(spark, sf).select("query_id", "doc_id").distinct().withColumn("score", F.lit(0.45))
    held = retrieval.rank_by(held, ["query_id"], F.col("doc_id"), most=20).select("query_id", "doc_id", "score", F.lit(1).cast("long").alias("source_rank"))
    return retrieval.merge_lists(near.unionByName(held), ["doc_id"], 10).select("query_id", "doc_id", "score", "source_rank", "rank")


@query("hash_embedding")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").withColumn("v", vector.hash_embedding(64)("text"))
    return rows.select("item_id", F.round(vector.norm(F.col("v")), 6).alias("norm"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "word_jaccard",
    r"""with w as (select item_id, list_distinct(list_filter(regexp_split_to_array(lower("text"), '\s+'), lambda x: x <> '')) as ws from benchmark)
    select a.item_id as a, b.item_id as b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) as similarity from w a join w b on a.item_id < b.item_id""",
)
def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    x, y = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")), b.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    # the benchmark is a small stated set
    return x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    "numeric_extract",
    r"""with m as (select page_id, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '(?i)(\d+[\s,.]?\d*)\s*%', 1)) as raw from pages)
    select page_id, count(*) as n, round(sum(try_cast(regexp_extract(replace(regexp_replace(raw, '\s', '', 'g'), ',', '.'), '^\d+\.?\d*') as double)), 6) as total from m group by page_id""",
)
def numeric_extract(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    raw = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(plain, F.lit(r"(?i)(\d+[\s,.]?\d*)\s*%"), F.lit(1))).alias("raw"))
    return raw.groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.sum(numeric.parse_number(F.col("raw"))), 6).alias("total"))
