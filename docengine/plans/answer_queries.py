"""Queries of whole answers: filtered search, pipelines over a batch of questions, validation of batches, formatting and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import confidence, lexicon, numeric, similarity, text
from docengine.operators import answers, hybrid, retrieval, trigrams
from docengine.plans import sqltext
from docengine.plans.questions import QUESTIONS, questions
from docengine.plans.registry import query, sql_list
from docengine.plans.retrieval_queries import _AXES, _HITS, WORDS_SQL, _axes, _candidates, semantic_sql
from docengine.plans.text_queries import VARIANTS_SQL, variant_queries
from docengine.plans.understanding_queries import SCENARIO_ASKS, SCENARIO_CASES, SCENARIO_CONCEPTS
from docengine.plans.web_queries import _EDGES_SQL, _LINKS, tree_edges
from docengine.sources import web
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table

# ---- points and documents


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id")


_COSINE = "round(list_cosine_similarity(wanted, embedding::double[]), 6)"


@query(
    "filtered_vector_topk",
    f"""with {_AXES}, s as (select query_id, vec_id as point_id, {_COSINE} as score from embeddings, a where label in (1, 3, 5) and vec_id % 2 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s) select * from r where rank <= 10""",
)
def filtered_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A payload filter, one value that must match and a list of which any may, before the top k."""
    return retrieval.vector_topk(_points(spark, sf).where(F.col("label").isin(1, 3, 5) & (F.col("point_id") % 2 == 0)), _axes(spark), 10)


@query("scroll_points", "select vec_id as point_id, label, row_number() over (order by vec_id) as place from (select * from embeddings where label = 2 order by vec_id limit 20)")
def scroll_points(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a filtered scan in the points' order."""
    return retrieval.numbered(_points(spark, sf).where("label = 2").select("point_id", "label"), 20, F.col("point_id"))


@query("paragraph_lookup", f"with {PARAGRAPHS_SQL} select p.doc_id, paragraph_number, content, d.source as document_name, d.lang from p join documents d on d.doc_id = p.doc_id where p.doc_id = 7 and paragraph_number = 1")
def paragraph_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("doc_id = 7")
    parent = docs.select("doc_id", F.col("source").alias("document_name"), "lang")
    return paragraphs(docs).where("paragraph_number = 1").join(parent, "doc_id")


@query("eligible_documents", "select doc_id, source, row_number() over (order by doc_id desc) as place from (select doc_id, source from documents join labels using (doc_id) where quality = 1 and lang in ('en', 'de') order by doc_id desc limit 50)")
def eligible_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Completed documents of a list of languages, newest first, one page of them."""
    docs = table(spark, sf, "documents").where(F.col("lang").isin("en", "de")).join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")
    return retrieval.numbered(docs.select("doc_id", "source"), 50, F.desc("doc_id"))


# ---- searches


@query(
    "engine_search",
    f"""with {_AXES}, s as (select query_id, vec_id as doc_id, {_COSINE} as score from embeddings, a),
    t as (select *, row_number() over (partition by query_id order by score desc, doc_id) as k from s where score >= 0.16),
    b as (select query_id, doc_id, round(least(1.0, score + least(0.3, case when regexp_matches(lower(coalesce("text", '')), '(^|[^A-Za-z0-9_])(that|with)($|[^A-Za-z0-9_])') then 0.2 else 0 end
        + len(list_filter(['there', 'nicht', 'pour'], lambda w: contains(lower(coalesce("text", '')), w))) * 0.03)), 6) as boosted from t join documents using (doc_id) where k <= 20),
    r as (select *, row_number() over (partition by query_id order by boosted desc, doc_id) as rank from b where boosted >= 0.2) select * from r where rank <= 10""",
)
def engine_search(spark: SparkSession, sf: str) -> DataFrame:
    """Twice the wanted number at four fifths of the threshold, then boosts, the threshold and the cut."""
    top = retrieval.vector_topk(_points(spark, sf), _axes(spark), 20, least=0.16).select("query_id", F.col("point_id").alias("doc_id"), "score")
    found = top.join(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")
    kinds = text.classify(F.col("content"), ("that", "with"), ("from",), ("this",))
    words = F.array(*[F.lit(w) for w in ("there", "nicht", "pour")])
    boosted = F.round(retrieval.legal_boost(F.col("score"), F.col("content"), F.lit("obligation"), words, kinds=kinds), 6)
    rows = found.select("query_id", "doc_id", boosted.alias("boosted")).where("boosted >= 0.2")
    return retrieval.rank_by(rows, ["query_id"], F.desc("boosted"), F.col("doc_id"), most=10)


@query(
    "legacy_pipeline",
    f"""with {_AXES}, {_HITS}, v as (select query_id + 1 as query_id, vec_id as doc_id, {_COSINE} as score from embeddings, a where query_id < 5),
    vt as (select *, row_number() over (partition by query_id order by score desc, doc_id) as n from v),
    kt as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as n from (select distinct query_id, doc_id from k)),
    u as (select query_id, doc_id, score, 0 as source_rank from vt where n <= 10 union all select query_id, doc_id, 0.5, 1 from kt where n <= 10),
    d as (select *, row_number() over (partition by query_id, doc_id order by source_rank, score desc) as n from u),
    r as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id) as citation_index from d where n = 1 and score >= 0.3)
    select query_id, citation_index, r.doc_id, coalesce(source, 'Unknown') as document_name, score from r left join documents using (doc_id) where citation_index <= 5""",
)
def legacy_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and keywords side by side, vectors first where both have a document, threshold, cut, names."""
    near = retrieval.vector_topk(_points(spark, sf), _axes(spark, 5), 10).select((F.col("query_id") + 1).alias("query_id"), F.col("point_id").alias("doc_id"), "score", F.lit(0).alias("source_rank"))
    held = retrieval.rank_by(_candidates(spark, sf).select("query_id", "doc_id").distinct(), ["query_id"], F.col("doc_id"), most=10)
    held = held.select("query_id", "doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("source_rank"))
    merged = retrieval.merge_lists(near.unionByName(held), ["doc_id"]).where("score >= 0.3 and rank <= 5")
    names = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"))
    return merged.join(names, "doc_id", "left").select("query_id", F.col("rank").alias("citation_index"), "doc_id", F.coalesce("document_name", F.lit("Unknown")).alias("document_name"), "score")


@query(
    "chat_variant_search",
    f"""with {_AXES}, s as (select query_id % 2 as query_id, query_id // 2 as variant, vec_id as doc_id, {_COSINE} as score from embeddings, a),
    t as (select *, row_number() over (partition by query_id, variant order by score desc, doc_id) as k from s),
    m as (select t.*, coalesce(source, '?') || '-' || substr(coalesce("text", ''), 1, 50) as key from t join documents using (doc_id) where k <= 3),
    d as (select *, row_number() over (partition by query_id, key order by variant, score desc, doc_id) as n from m),
    r as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from d where n = 1) select * from r where rank <= 5""",
)
def chat_variant_search(spark: SparkSession, sf: str) -> DataFrame:
    """Four variants of each question, three points each, one of each document's beginnings."""
    top = retrieval.vector_topk(_points(spark, sf), _axes(spark), 3)
    top = top.select((F.col("query_id") % 2).alias("query_id"), F.expr("query_id div 2").alias("source_rank"), F.col("point_id").alias("doc_id"), "score")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("?")), F.lit("-"), F.left(F.coalesce("text", F.lit("")), F.lit(50))).alias("key"))
    once = retrieval.rank_by(top.join(docs, "doc_id"), ["query_id", "key"], F.col("source_rank"), F.desc("score"), F.col("doc_id"), most=1, name="n")
    return retrieval.rank_by(once.select("query_id", "doc_id", "score"), ["query_id"], F.desc("score"), F.col("doc_id"), most=5)


# ---- the flagship: a batch of questions from search to the confidence gate

#: Stated questions of the flagship, each beside the axis that is its vector; the last two ask for bans and duties.
ASKED = (*QUESTIONS, (6, "Ce este interzis la montarea prizelor"), (7, "Care sunt obligațiile si este obligatoriu acest lucru"))
_ASKED_VALUES = ", ".join(f"({i}, {sqltext.sql_text(q)})" for i, q in ASKED)

#: Phrases that are scanned for where a question asks for bans: one for each language of the texts.
_BAN_PHRASES = ("that the", "nicht auch", "pour les", "que para")

_FLAGSHIP_CTES = f"""q as (select cast(query_id as bigint) as query_id, q, regexp_matches(translate(lower(q), 'ăâîșşțţ', 'aaisstt'), '{"|".join(answers.BAN_STEMS)}') as is_ban from (values {_ASKED_VALUES}) t(query_id, q)),
    w as (select *, list_transform(range(0, 64), lambda i: case when i = query_id then 1.0::double else 0.0::double end) as wanted from q), {PARAGRAPHS_SQL},
    s as (select query_id, is_ban, vec_id as doc_id, {_COSINE} as score from w, embeddings where label <> 9),
    v as (select *, row_number() over (partition by query_id order by score desc, doc_id) as k from s where score >= 0.15),
    vt as (select query_id, doc_id, score from v where k <= case when is_ban then 30 else 10 end),
    ph as (select unnest({sql_list(_BAN_PHRASES)}) as phrase),
    kb as (select phrase, doc_id, row_number() over (partition by phrase order by doc_id) as k from (select distinct phrase, doc_id from p, ph where contains(lower(content), phrase))),
    kt as (select distinct query_id, doc_id from q, kb where is_ban and k <= 20),
    u as (select query_id, doc_id, score, 0 as source_rank from vt union all select query_id, doc_id, 0.45, 1 from kt anti join vt using (query_id, doc_id)),
    r as (select u.*, is_ban, row_number() over (partition by query_id order by source_rank, score desc, doc_id) as citation_index from u join q using (query_id) where score >= 0.2),
    c as (select query_id, citation_index, r.doc_id, coalesce(source, 'Unknown') as document_name, round(score, 6) as score from r left join documents using (doc_id) where citation_index <= case when is_ban then 10 else 5 end)"""


def _flagship(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked = spark.createDataFrame(list(ASKED), "query_id long, text string")
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("query_id"), 1.0).otherwise(0.0))
    asked = asked.withColumns({"embedding": axis, "is_ban": answers.is_ban_question(F.col("text"))})
    names = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"))
    points = _points(spark, sf).where("label <> 9").withColumnRenamed("point_id", "doc_id")
    return asked, answers.cite(asked, points, paragraphs(table(spark, sf, "documents")), names, answers.Limits(threshold=0.2, phrases=_BAN_PHRASES))


@query("question_citations", f"with {_FLAGSHIP_CTES} select * from c")
def question_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's citations."""
    return _flagship(spark, sf)[1]


@query(
    "question_answers",
    f"""with {_FLAGSHIP_CTES}, g as (select q.query_id, q, is_ban, count(c.score) as n_citations, cast(coalesce(floor(avg(c.score) * 100 + 0.5), 0) as bigint) as confidence from q left join c using (query_id) group by all)
    select query_id, is_ban, n_citations, confidence, confidence < 40 as needs_clarification,
    case {" ".join(f"when {sqltext.contains_any('q', terms)} then '{name}'" for name, terms in lexicon.ROUTE_INTENTS)} else 'general' end as intent from g""",
)
def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a batch of questions searched, cited, weighed and gated."""
    asked, cited = _flagship(spark, sf)
    return answers.gate(asked, cited)


# ---- validation of batches

_CORRUPT = "case (doc_id + paragraph_number) % 6 when 0 then content when 1 then translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then {sub}(content, 1, cast(floor({len}(content) * 0.9) as int)) when 3 then {sub}(content, 1, 12) when 4 then regexp_replace(content, '[eE]', 'x') else content || ' zq zw' end"
_CORRUPT_SQL = _CORRUPT.format(sub="substr", len="length")


def corrupted(p: DataFrame) -> DataFrame:
    """Paragraphs beside a stated corruption of themselves: equal, capitals, cut, cut short, one letter, two words more."""
    first_e = F.concat(F.regexp_extract("content", r"(?s)^([^eE]*)[eE]", 1), F.lit("x"), F.regexp_extract("content", r"(?s)^[^eE]*[eE](.*)$", 1))
    kind = (F.col("doc_id") + F.col("paragraph_number")) % 6
    cited = (
        F.when(kind == 0, F.col("content"))
        .when(kind == 1, F.translate("content", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(kind == 2, F.left("content", F.floor(F.char_length("content") * 0.9).cast("int")))
        .when(kind == 3, F.left("content", F.lit(12)))
        .when(kind == 4, F.when(F.col("content").rlike("[eE]"), first_e).otherwise(F.col("content")))
        .otherwise(F.concat("content", F.lit(" zq zw")))
    )
    return p.withColumn("cited", cited)


_LADDER_COLS = ", ".join(f"{v} as {k}" for k, v in sqltext.ladder("s", "c", "a", "b").items())
_LADDER_CTES = f"""{PARAGRAPHS_SQL}, t as (select doc_id, paragraph_number, trim(content, ' ') as s, trim({_CORRUPT_SQL}, ' ') as c from p),
    n as (select *, {sqltext.normalized('s')} as a, {sqltext.normalized('c')} as b from t)"""


@query("citation_ladder", f"with {_LADDER_CTES} select doc_id, paragraph_number, {_LADDER_COLS} from n")
def citation_ladder(spark: SparkSession, sf: str) -> DataFrame:
    p = corrupted(paragraphs(table(spark, sf, "documents")))
    return similarity.validate(p, "content", "cited").select("doc_id", "paragraph_number", "method", "confidence", "is_valid")


@query("count_by_method", f"with {_LADDER_CTES}, v as (select {_LADDER_COLS} from n) select method, count(*) as n, count(*) filter (is_valid) as n_valid from v group by method")
def count_by_method(spark: SparkSession, sf: str) -> DataFrame:
    """How many citations each rung of the ladder settles."""
    return citation_ladder(spark, sf).groupBy("method").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"))


@query(
    "citation_batch",
    f"""with {_LADDER_CTES}, v as (select doc_id, paragraph_number, {_LADDER_COLS} from n),
    k as (select doc_id, case when (doc_id + paragraph_number) % 7 = 0 then paragraph_number + 1000000 else paragraph_number end as cited_number, paragraph_number from p)
    select k.doc_id, k.cited_number, coalesce(method, 'VALIDATION_FAILED') as method, coalesce(confidence, 0) as confidence, coalesce(is_valid, false) as is_valid
    from k left join v on v.doc_id = k.doc_id and v.paragraph_number = k.cited_number""",
)
def citation_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of citations, some of paragraphs that do not exist."""
    p = paragraphs(table(spark, sf, "documents"))
    lost = (F.col("doc_id") + F.col("paragraph_number")) % 7 == 0
    cited = corrupted(p).select("doc_id", F.when(lost, F.col("paragraph_number") + 1_000_000).otherwise(F.col("paragraph_number")).alias("paragraph_number"), "cited")
    out = answers.validate_batch(cited, p)
    return out.select("doc_id", F.col("paragraph_number").alias("cited_number"), "method", "confidence", "is_valid")


_NEAR_SQL = r"regexp_replace(content, '^\S+\s+\S+', 'inlocuit')"


@query(
    "factual_accuracy",
    f"""with {PARAGRAPHS_SQL}, t as (select doc_id, paragraph_number, {sqltext.key_terms(sqltext.normalized(_NEAR_SQL))} as x, {sqltext.key_terms(sqltext.normalized('content'))} as y from p),
    d as (select doc_id, paragraph_number, len(list_filter(y, lambda w: not list_contains(x, w))) as missing, len(list_filter(x, lambda w: not list_contains(y, w))) as added from t)
    select *, missing <= 2 and added <= 2 as is_valid, case when missing + added = 0 then 100 when missing > 2 or added > 2 then greatest(0, 100 - (missing + added) * 10) else 90 - (missing + added) * 5 end as confidence from d""",
)
def factual_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    near = F.regexp_replace("content", r"^\S+\s+\S+", "inlocuit")
    p = p.withColumns({"x": similarity.normalize_citation(near), "y": similarity.normalize_citation(F.col("content"))})
    p = p.withColumns({"x": similarity.key_terms(F.col("x")), "y": similarity.key_terms(F.col("y"))})
    return p.select("doc_id", "paragraph_number", *[c.alias(n) for n, c in similarity.factual_accuracy(F.col("x"), F.col("y")).items()])


_RELEVANCE_SQL = f"""case when len(terms) = 0 then 0.5 else least(1.0, len(list_filter(terms, lambda t: contains(c, t))) / len(terms) * 0.7 + {sqltext.related_concepts('n', 'c')} * 0.3 + case when contains(c, n) then 0.3 else 0 end) end"""


@query(
    "relevance_score",
    f"""with {PARAGRAPHS_SQL}, t as (select doc_id, {sqltext.normalized('content')} as c from p), q as (select cast(query_id as bigint) as query_id, {sqltext.normalized('q')} as n, {sqltext.key_terms(sqltext.normalized('q'))} as terms from (values {", ".join(f"({i}, {sqltext.sql_text(x)})" for i, x in QUESTIONS)}) v(query_id, q))
    select query_id, doc_id, max(round({_RELEVANCE_SQL}, 6)) as relevance from t, q group by query_id, doc_id""",
)
def relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark).select("query_id", similarity.normalize_citation(F.col("text")).alias("q"))
    asked = asked.withColumns({"terms": similarity.key_terms(F.col("q")), "q_counts": similarity.concept_counts(F.col("q"))})
    p = paragraphs(table(spark, sf, "documents")).select("doc_id", similarity.normalize_citation(F.col("content")).alias("c"))
    p = p.withColumn("c_counts", similarity.concept_counts(F.col("c"))).join(F.broadcast(asked))
    relevance = similarity.relevance(F.col("q"), F.col("terms"), F.col("c"), F.col("q_counts"), F.col("c_counts"))
    scored = p.select("query_id", "doc_id", F.round(relevance, 6).alias("relevance"))
    return scored.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


_TOP5_SQL = "t5 as (select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph_number) as place from k)"


def _top5(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rank_by(_candidates(spark, sf), ["query_id"], F.desc("score"), F.col("doc_id"), F.col("paragraph_number"), most=5)


@query(
    "blended_confidence",
    f"""with {_HITS}, {_TOP5_SQL}, x as (select t5.query_id, score, {sqltext.normalized('content')} as c, {sqltext.normalized('q')} as n, {sqltext.key_terms(sqltext.normalized('q'))} as terms from t5 where place <= 5)
    select query_id, count(*) as n_citations, cast(floor(round(avg(floor(score * 100 + 0.5) / 100 * 0.6 + {_RELEVANCE_SQL} * 0.4) * 100, 6) + 0.5) as bigint) as confidence from x group by query_id""",
)
def blended_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of the citations and their relevance, three to two."""
    asked = questions(spark).select("query_id", similarity.normalize_citation(F.col("text")).alias("n"))
    asked = F.broadcast(asked.withColumn("terms", similarity.key_terms(F.col("n"))))
    cited = _top5(spark, sf).join(asked, "query_id").withColumn("relevance", similarity.relevance(F.col("n"), F.col("terms"), similarity.normalize_citation(F.col("content"))))
    return cited.groupBy("query_id").agg(F.count("*").alias("n_citations"), answers.blended(text.js_round(F.col("score") * 100), F.col("relevance")).alias("confidence"))


@query(
    "answer_disclaimer",
    f"""with {_HITS}, {_TOP5_SQL}, f as (select query_id, bool_or(regexp_matches(lower(content), '\\b(that|with|und)\\b')) as o, bool_or(regexp_matches(lower(content), '\\b(from|nicht)\\b')) as f from t5 where place <= 5 group by query_id)
    select query_id, case when o and f then {sqltext.sql_text(answers.DISCLAIMERS[0])} when o then {sqltext.sql_text(answers.DISCLAIMERS[1])} when f then {sqltext.sql_text(answers.DISCLAIMERS[2])} else {sqltext.sql_text(answers.DISCLAIMERS[3])} end as disclaimer from f""",
)
def answer_disclaimer(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("content")
    return _top5(spark, sf).groupBy("query_id").agg(answers.disclaimer(low.rlike(text.whole_word(("that", "with", "und"))), low.rlike(text.whole_word(("from", "nicht")))).alias("disclaimer"))


# ---- questions


@query("ban_question", f"select conv_id, turn, regexp_matches(translate(lower(coalesce(\"text\", '') || case when conv_id % 3 = 0 then ' este INTERZIS' when conv_id % 3 = 1 then ' Obligații?' else '' end), 'ăâîșşțţ', 'aaisstt'), '{'|'.join(answers.BAN_STEMS)}') as is_ban from conversations")
def ban_question(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("conv_id") % 3 == 0, " este INTERZIS").when(F.col("conv_id") % 3 == 1, " Obligații?").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", answers.is_ban_question(F.concat(F.coalesce("text", F.lit("")), tail)).alias("is_ban"))


_VARIANTS_SQL = f"""{VARIANTS_SQL},
    d(term, k, syn) as (values {', '.join(f"('{t}', {k}, '{s}')" for t, ss in lexicon.SYNONYMS.items() for k, s in enumerate(ss))}),
    w as (select query_id, q, unnest(string_split(lower(q), ' ')) as word, unnest(range(1, len(string_split(q, ' ')) + 1)) as pos from q),
    t as (select query_id, q, word, min(pos) as pos from w where word in (select term from d) group by all),
    v as (select query_id, q as variant, -1 as pos, 0 as k from q union all
          select t.query_id, trim(replace(' ' || lower(t.q) || ' ', ' ' || t.word || ' ', ' ' || d.syn || ' '), ' '), t.pos, d.k from t join d on d.term = t.word),
    u as (select query_id, variant, min(pos * 10 + k) as o from v group by all),
    r as (select query_id, variant, row_number() over (partition by query_id order by o) as rank from u)"""


@query("query_expansion", f"with {_VARIANTS_SQL} select cast(query_id as bigint) as query_id, string_agg(variant, ' | ' order by rank) as expanded from r where rank <= 5 group by query_id")
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.query_variants(variant_queries(spark, sf), most=5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "variant"))).alias("v"))
    return rows.select("query_id", F.array_join(F.transform("v", lambda x: x["variant"]), " | ").alias("expanded"))


def _mark_sql(x: str) -> str:
    for term, synonyms in lexicon.SYNONYMS.items():
        marked = x
        for t in (term, *synonyms):
            marked = rf"regexp_replace({marked}, '\b({t})\b', '**\1**', 'gi')"
        x = f"(case when list_contains(string_split(lower(q), ' '), '{term}') then {marked} else {x} end)"
    return x


@query("synonym_highlight", f"""with {VARIANTS_SQL} select cast(query_id as bigint) as query_id, {_mark_sql("'tablou electric si cablu, conductor; prize: siguranta '")} as marked from q""")
def synonym_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """Marks the known words of a question and their synonyms in a text."""
    shown = F.lit("tablou electric si cablu, conductor; prize: siguranta ")
    return variant_queries(spark, sf).select("query_id", answers.mark_synonyms(shown, F.lower("text")).alias("marked"))


@query("unnecessary_clarification", f"""select conv_id, turn, {sqltext.contains_any("coalesce(\"text\", '') || case when turn % 4 = 1 then ' Cupru sau aluminiu?' when turn % 4 = 2 then ' ce curent' else '' end", answers.UNNECESSARY)} as unnecessary from conversations""")
def unnecessary_clarification(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("turn") % 4 == 1, " Cupru sau aluminiu?").when(F.col("turn") % 4 == 2, " ce curent").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.contains_any(F.concat(F.coalesce("text", F.lit("")), tail), answers.UNNECESSARY).alias("unnecessary"))


# ---- numbers

_UNIT_SQL = {
    "mm": "mm|milimetri", "cm": "cm|centimetri", "m": "m(?:[^mM]|$)", "A": "A|amperi", "V": "V|volti", "Ω": "Ω|ohmi", "kW": "kW|kilowatti", "mm²": "mm²|mm2", "%": "%", "°C": r"°C|grade\s*Celsius",
}


def _measured_sql(source: str, keys: str, body: str) -> str:
    """All measurements of a table; RE2 has no look-ahead, so the plain metre takes the character behind it along."""
    parts = [rf"select {keys}, '{u}' as unit, {k} as unit_no, regexp_extract_all({body}, '(?i)(\d+[\s,.]?\d*)\s*(?:{x})', 1) as raws from {source}" for k, (u, x) in enumerate(_UNIT_SQL.items())]
    parts.append(rf"select {keys}, 'IP', 99, regexp_extract_all({body}, '(?i)IP\s*(\d{{2}})', 1) from {source}")
    flat = f"select {keys}, unit, unit_no, unnest(raws) as raw, unnest(range(1, len(raws) + 1)) as pos from ({' union all '.join(parts)})"
    return rf"select *, try_cast(regexp_extract(replace(regexp_replace(raw, '\s', '', 'g'), ',', '.'), '^\d+\.?\d*') as double) as value from ({flat})"


_MEASURED = f"""m as ({_measured_sql("documents", "doc_id", "coalesce(\"text\", '')")})"""
_MATCH_SQL = "(case when lower(unit) = 'mm' then 30 else 0 end + case when value >= 30 then 40 + case when value - 30 < 6 then 10 else 0 end else 0 end)"


@query("measurements", f"with {_MEASURED} select doc_id, unit, count(*) as n, round(sum(value), 6) as total from m group by doc_id, unit")
def measurements(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(numeric.measurements(F.coalesce("text", F.lit("")))).alias("m"))
    return found.groupBy("doc_id", "m.unit").agg(F.count("*").alias("n"), F.round(F.sum("m.value"), 6).alias("total"))


def _asked_numbers(spark: SparkSession) -> DataFrame:
    return F.broadcast(questions(spark).withColumn("question", numeric.numeric_question(F.col("text"))).where("question is not null"))


@query("numeric_score", f"with {_MEASURED} select cast(5 as bigint) as query_id, doc_id, round(cast(sum({_MATCH_SQL}) as double), 6) as relevance from m group by doc_id")
def numeric_score(spark: SparkSession, sf: str) -> DataFrame:
    """How well a document's numbers fit the questions that ask for one; of the stated ones the fifth: 30 mm at least."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(numeric.measurements(F.coalesce("text", F.lit("")))).alias("m")).join(_asked_numbers(spark))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum(numeric.match_score(F.col("m.value"), F.col("m.unit"), F.col("question"))), 6).alias("relevance"))


@query("numeric_boost", f"with {_MEASURED}, s as (select doc_id, sum({_MATCH_SQL}) as total from m group by doc_id) select doc_id, round(least(1.0, 0.3 + coalesce(total, 0) / 100), 6) as score from documents left join s using (doc_id)")
def numeric_boost(spark: SparkSession, sf: str) -> DataFrame:
    """A score that the matching numbers raise, at most to 1."""
    docs = table(spark, sf, "documents").select("doc_id", numeric.measurements(F.coalesce("text", F.lit(""))).alias("ms")).join(_asked_numbers(spark).hint("broadcast"))
    total = F.aggregate("ms", F.lit(0.0), lambda a, m: a + numeric.match_score(m["value"], m["unit"], F.col("question")))
    return docs.select("doc_id", F.round(answers.boosted_by_numbers(F.lit(0.3), total), 6).alias("score"))


@query(
    "numeric_formatted",
    f"""with {_MEASURED}, d as (select doc_id, value, unit, min(unit_no * 1000000 + pos) as o from m where value is not null group by all), r as (select *, row_number() over (partition by doc_id order by o) as n from d)
    select doc_id, string_agg('**' || case when value = floor(value) and value < 9e18 then cast(cast(value as bigint) as varchar) else cast(value as varchar) end || ' ' || unit || '**', chr(10) order by n) as shown from r where n <= 5 group by doc_id""",
)
def numeric_formatted(spark: SparkSession, sf: str) -> DataFrame:
    """The first five different numbers with units of a document, for display."""
    docs = table(spark, sf, "documents").select("doc_id", answers.shown_numbers(numeric.measurements(F.coalesce("text", F.lit("")))).alias("shown"))
    return docs.where("shown <> ''")


_EXPECTED = ("30 mm", "16 A", "5 %")


@query(
    "expected_values",
    f"""with e as (select doc_id, lower(coalesce("text", '')) as t, n_chars from documents),
    f as (select doc_id, n_chars, {" + ".join(f"cast(not (contains(t, '{x.lower()}') or contains(t, '{x.lower().replace(' ', '', 1)}')) as int)" for x in _EXPECTED)} as missing from e) select doc_id, cast(missing as bigint) as n_missing, missing = 0 or n_chars > 5000 as is_relevant from f""",
)
def expected_values(spark: SparkSession, sf: str) -> DataFrame:
    """Expected values that a text holds in no spelling; relevant if none is missing or the score, here the length, is high."""
    from docengine.operators.understanding import missing_values

    missing = F.size(missing_values(F.array(*[F.lit(x) for x in _EXPECTED]), F.coalesce("text", F.lit("")))).cast("long")
    return table(spark, sf, "documents").select("doc_id", missing.alias("n_missing"), ((missing == 0) | (F.col("n_chars") > 5000)).alias("is_relevant"))


# ---- formatting


@query(
    "passthrough_sentence",
    r"""with d as (select doc_id, coalesce("text", '') as t, regexp_extract_all(coalesce("text", ''), '[^.!?]+[.!?]+') as ss from documents),
    w as (select ['what', 'that', 'which', 'comes', 'with', 'this', 'from', 'there'] as ws),
    x as (select doc_id, t, ss, unnest(case when len(ss) = 0 then [t] else ss end) as s, unnest(range(1, greatest(len(ss), 1) + 1)) as k from d),
    y as (select x.*, len(list_filter(ws, lambda v: contains(translate(lower(s), 'ăâîșşțţ', 'aaisstt'), v))) + case when regexp_matches(s, '\d') then 0.5 else 0 end as score from x, w),
    r as (select *, row_number() over (partition by doc_id order by score desc, k) as n from y)
    select doc_id, sha256(case when len(ss) <= 1 then substr(t, 1, 300) || case when length(t) > 300 then '...' else '' end else substr(trim(s, chr(32) || chr(10) || chr(9) || chr(13)), 1, 300) || case when length(s) > 300 then '...' else '' end end) as shown_sha from r where n = 1""",
)
def passthrough_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence that answers the first question best, as it stands."""
    asked = F.array(*[F.lit(w) for w in QUESTIONS[0][1].lower().split() if len(w) > 3])
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.sha2(answers.passthrough(body, asked), 256).alias("shown_sha"))


_SPANS_SQL = {"citation": r"\[\d+\]", "measure": r"\d+(?:[.,]\d+)?\s*(?:mm|cm|kW|%)", "obligation": r"\b(?:trebuie|obligatoriu|must|shall)\b", "prohibition": r"\b(?:interzis|forbidden)\b"}


@query("inline_spans", "with t as (select doc_id, coalesce(\"text\", '') as t from documents) select doc_id, " + ", ".join(f"len(regexp_extract_all(t, '(?i){p}')) as {n}" for n, p in _SPANS_SQL.items()) + " from t")
def inline_spans(spark: SparkSession, sf: str) -> DataFrame:
    """How many spans of each kind a text has that are shown in a style of their own."""
    return table(spark, sf, "documents").select("doc_id", *[F.size(spans).cast("long").alias(name) for name, spans in answers.inline_spans(F.coalesce("text", F.lit(""))).items()])


@query(
    "keyword_ratio",
    r"""with k(w) as (values ('that the'), ('nicht'), ('pour les'), ('zzz')), t as (select conv_id, turn, lower(coalesce("text", '')) as t from conversations)
    select conv_id, turn, cast(floor(100 * sum(cast(contains(t, w) or len(list_filter(string_split(w, ' '), lambda p: contains(t, p))) > 0 as int)) / 4 + 0.5) as bigint) as percent from t, k group by conv_id, turn""",
)
def keyword_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of expected keywords that an answer holds, whole or in part."""
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("t")).select("conv_id", "turn", answers.keyword_percent(F.col("t"), ("that the", "nicht", "pour les", "zzz")).alias("percent"))


# ---- quizzes


@query(
    "quiz_router",
    rf"""with {PARAGRAPHS_SQL}, o(question_id, letter, keywords, value) as (values {answers.quiz_values_sql()}),
    low as (select lower(content) as c from p), w as (select question_id, letter, value, unnest(keywords) as keyword from o),
    pieces as (select distinct keyword as piece from w union select distinct unnest(string_split(keyword, ' ')) from w union select distinct value from o where value <> ''),
    held as (select piece from pieces where exists (select 1 from low where contains(c, piece))),
    hl as (select coalesce(list(piece), []) as pl from held),
    ks as (select question_id, letter, sum(case when list_contains(pl, keyword) then 2 else 0 end + 0.5 * len(list_filter(string_split(keyword, ' '), lambda x: length(x) > 4 and list_contains(pl, x)))) as kscore from w, hl group by all),
    s as (select o.question_id, o.letter, kscore + case when value <> '' and value in (select piece from held) then 3 else 0 end as score from o join ks using (question_id, letter)),
    r as (select *, row_number() over (partition by question_id order by score desc, letter) as n, score - coalesce(lead(score) over (partition by question_id order by score desc, letter), 0) as margin from s)
    select cast(question_id as bigint) as question_id, case when score > 0 and margin >= 2 then letter end as letter, cast(score as double) as score, cast(case when score > 0 and margin >= 2 then least(60 + 5 * margin, 90) else 0 end as double) as confidence,
    case when score > 0 and margin >= 2 and least(60 + 5 * margin, 90) >= 75 then 'keyword' else 'ai' end as method from r where n = 1""",
)
def quiz_router(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores of quiz options against all paragraphs; a lead of less than two, or low confidence, goes on to the model."""
    return answers.route_quiz(answers.quiz_options(spark), paragraphs(table(spark, sf, "documents")))


@query(
    "quiz_restrictions",
    f"""with {PARAGRAPHS_SQL}, o(option_id, concept) as (values {", ".join(f"({i}, '{c}')" for i, c in answers.RESTRICTED)}), h as (select option_id, concept from o)
    select cast(option_id as bigint) as option_id, exists (select 1 from p where contains(lower(content), 'numai ' || concept) or contains(lower(content), 'doar ' || concept) or contains(lower(content), 'that ' || concept)) as confirmed from h""",
)
def quiz_restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """Do the texts restrict what an option restricts?"""
    return answers.check_restrictions(answers.restricted(spark), paragraphs(table(spark, sf, "documents")), ("numai", "doar", "that"))


# ---- limits, queues, context, crawls


@query(
    "limit_presets",
    """with p(preset, seconds, most) as (values ('api', 60, 60), ('query', 60, 10), ('upload', 3600, 10)),
    w as (select preset, most, user_id, (epoch_us(ts) // 1000000) // seconds as slot, count(*) as n from events, p group by all) select preset, count(*) as windows, count(*) filter (n > most) as over_limit, max(n) as most_in_window from w group by preset""",
)
def limit_presets(spark: SparkSession, sf: str) -> DataFrame:
    return answers.preset_use(table(spark, sf, "events"))


@query("queue_stats", "select count(*) filter (o_orderstatus = 'O') as waiting, count(*) filter (o_orderstatus = 'P') as active, count(*) filter (o_orderstatus = 'F') as completed, count(*) as total from orders")
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return table(spark, sf, "orders").agg(count("O", "waiting"), count("P", "active"), count("F", "completed"), F.count("*").alias("total"))


@query(
    "context_summary",
    """with m as (select conv_id, turn, coalesce("text", '') as t, row_number() over (partition by conv_id order by turn desc, coalesce("text", '')) as n from conversations where role = 'user')
    select conv_id, count(*) as n_recent, string_agg(substr(t, 1, 50), ' | ' order by n desc) as summary from m where n <= 3 group by conv_id""",
)
def context_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The beginnings of a conversation's last three questions."""
    said = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    last = retrieval.rank_by(said, ["conv_id"], F.desc("turn"), F.col("t"), most=3, name="n")
    rows = last.groupBy("conv_id").agg(F.count("*").alias("n_recent"), F.sort_array(F.collect_list(F.struct("n", F.left("t", F.lit(50)).alias("s"))), asc=False).alias("all"))
    return rows.select("conv_id", "n_recent", F.array_join(F.transform("all", lambda x: x["s"]), " | ").alias("summary"))


_PATHS_SQL = f"{_EDGES_SQL}, c(node, path) as (select 'r0', 'r0' union all select e.dst, path || ' > ' || e.dst from c join e on e.src = c.node where length(path) - length(replace(path, '>', '')) < 2)"


@query("category_paths", f"with recursive {_PATHS_SQL} select node, path from c")
def category_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl to a stated depth that carries each node's path."""
    return web.crawl_paths(tree_edges(spark, sf), spark.createDataFrame([("r0",)], "node string"), 2)


@query("category_groups", f"with recursive {_PATHS_SQL} select regexp_replace(path, ' > [^>]*$', '') as category, count(*) as n from c where node <> 'r0' group by 1")
def category_groups(spark: SparkSession, sf: str) -> DataFrame:
    paths = web.crawl_paths(tree_edges(spark, sf), spark.createDataFrame([("r0",)], "node string"), 2).where("node <> 'r0'")
    return paths.groupBy(F.regexp_replace("path", " > [^>]*$", "").alias("category")).agg(F.count("*").alias("n"))


@query("listing_pages", f"with {_LINKS}, n as (select page_id, count(*) as n_links, count(*) filter (regexp_matches(lower(url), '\\.(pdf|docx?|zip|html)([?#]|$)')) as n_files from l group by page_id) select page_id, n_links, n_files, n_links >= 4 and n_files * 2 >= n_links as is_listing from n")
def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of which at least half of four links or more are files."""
    return web.listings(web.page_links(table(spark, sf, "pages")))


def _category_sql(x: str) -> str:
    from docengine.operators.understanding import CATEGORIES

    return "case " + " ".join(f"when {sqltext.contains_any(x, words)} then {sqltext.sql_text(name)}" for words, name in CATEGORIES) + " else 'Legislație ANRE' end"


@query("prewarm_categories", f"""with t as (select coalesce(source, '') || case item % 5 when 0 then ' NTE' when 1 then ' lege' when 2 then ' ordin' else '' end as s from (select source, doc_id as item from documents)) select {_category_sql('s')} as category, count(*) as n from t group by 1""")
def prewarm_categories(spark: SparkSession, sf: str) -> DataFrame:
    from docengine.operators.understanding import file_category

    k = F.col("doc_id") % 5
    name = F.concat(F.coalesce("source", F.lit("")), F.when(k == 0, " NTE").when(k == 1, " lege").when(k == 2, " ordin").otherwise(""))
    return table(spark, sf, "documents").groupBy(file_category(name).alias("category")).agg(F.count("*").alias("n"))


@query("embedding_batches", """with b as (select doc_id // 16 as batch, count(*) as n, bool_or(length(coalesce("text", '')) > 30000) as bad from documents group by 1) select batch, case when bad then 0 else n end as succeeded, case when bad then n else 0 end as failed from b""")
def embedding_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches given to an embedding function; one that fails leaves its texts without vectors and the others alone."""
    batches = table(spark, sf, "documents").select(F.expr("doc_id div 16").alias("batch"), F.coalesce("text", F.lit("")).alias("text"))
    out = answers.embed_batches(batches, answers.length_embedding(30_000))
    return out.groupBy("batch").agg(F.count_if(F.size("embedding") > 0).alias("succeeded"), F.count_if(F.size("embedding") == 0).alias("failed"))


# ---- rendering and guidance

_ACCENTS = ("ăâîșşțţáàäéèêëíìïóòöúùüçñ", "aaissttaaaeeeeiiiooouuucn")


@query("quiz_key_terms", f"""select conv_id, turn, array_to_string(list_filter({sql_list(answers.KEY_TERMS)}, lambda t: contains(translate(lower(coalesce("text", '')), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), t)), ';') as terms from conversations""")
def quiz_key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(answers.key_terms_of(F.coalesce("text", F.lit(""))), ";").alias("terms"))


def _guidance_sql() -> str:
    line = lambda x: "chr(10) || " + " || chr(10) || ".join(sqltext.sql_text(t) for t in x)
    inst, context = (sqltext.contains_any("t", lexicon.SCENARIOS[k]) for k in ("installation", "specificContext"))
    parts = " || ".join(f"case when {c} then {line(x)} else '' end" for c, x in zip((inst, "concepts > 1", context, "complexity > 3"), answers.GUIDANCE[1:], strict=True))
    return f"case when complexity >= 2 or n_types >= 2 then {sqltext.sql_text(answers.GUIDANCE[0])} || {parts} else {sqltext.sql_text(answers.DIRECT)} end"


_ASKED_SQL = "lower(coalesce(\"text\", '') || case turn % 4 when 0 then ' cum se face montare ddr si priza in cazul' when 2 then ' verificare cablu' else '' end)"


@query(
    "answer_guidance",
    f"""with q as (select conv_id, turn, {_ASKED_SQL} as t from conversations),
    s as (select conv_id, turn, t, {SCENARIO_CASES} as types, {SCENARIO_CONCEPTS} as concepts, {SCENARIO_ASKS} as asks from q),
    r as (select conv_id, turn, t, concepts, types + case when concepts > 1 then concepts else 0 end + asks as complexity, types + case when concepts > 1 then 1 else 0 end as n_types from s)
    select conv_id, turn, {_guidance_sql()} as guidance from r""",
)
def answer_guidance(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 4
    said = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " cum se face montare ddr si priza in cazul").when(k == 2, " verificare cablu").otherwise(""))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", said.alias("said"))
    case = confidence.scenario(F.col("said"))
    return rows.select("conv_id", "turn", answers.guidance(F.col("said"), case["is_practical"], case["complexity"]).alias("guidance"))


def _templated_sql(style: str) -> str:
    opening, each, only = answers.STYLES[style]

    def filled(pattern: str) -> str:
        out = sqltext.sql_text(pattern).replace("\n", "' || chr(10) || '")
        for name, column in (("i", "place"), ("name", "document_name"), ("ref", "reference"), ("text", "content")):
            out = out.replace("{" + name + "}", f"' || {column} || '")
        return out

    return f"select '{style}' as style, query_id, sha256(case when count(*) = 1 then max({filled(only)}) else {sqltext.sql_text(opening)} || chr(10) || string_agg({filled(each)}, chr(10) order by place) end) as answer_sha from c group by query_id"


@query(
    "template_answers",
    f"""with {_HITS}, {_TOP5_SQL}, c as (select query_id, place, content, coalesce(source, 'Unknown') as document_name, 'parag. ' || paragraph_number as reference from t5 left join documents using (doc_id) where place <= case when query_id = 1 then 1 else 5 end)
    {" union all ".join(map(_templated_sql, answers.STYLES))}""",
)
def template_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The citations of each question as an answer in four styles; the first question has one citation only."""
    names = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("Unknown")).alias("document_name"))
    cited = _top5(spark, sf).where(F.col("rank") <= F.when(F.col("query_id") == 1, 1).otherwise(5)).join(names, "doc_id", "left")
    cited = cited.select("query_id", F.col("rank").alias("citation_index"), "document_name", F.concat(F.lit("parag. "), F.col("paragraph_number").cast("string")).alias("reference"), "content")
    out = None
    for style in answers.STYLES:
        one = answers.templated(cited, style).select(F.lit(style).alias("style"), "query_id", F.sha2("answer", 256).alias("answer_sha"))
        out = one if out is None else out.unionByName(one)
    return out


_NUMERIC_OPTIONS = ((1, "a", "99999999", "mm", "zz"), (1, "b", "1", "e", "the"), (1, "c", "2", "e", "a"), (2, "a", "5", "zzz", "the"), (2, "b", "7", "e", "e"), (3, "a", "123456789", "q", "q"))


@query(
    "quiz_numeric_context",
    f"""with {PARAGRAPHS_SQL}, s as (select unnest(regexp_split_to_array(lower(content), '[.!?]+')) as s from p), o(question_id, letter, value, unit, keyword) as (values {", ".join(map(str, _NUMERIC_OPTIONS))})
    select cast(question_id as bigint) as question_id, min(letter) as letter, 98 as confidence from o where exists (select 1 from s where contains(s, unit) and contains(s, keyword) and regexp_matches(s, '(^|[^0-9])' || value || '([^0-9]|$)')) group by question_id""",
)
def quiz_numeric_context(spark: SparkSession, sf: str) -> DataFrame:
    options = spark.createDataFrame(list(_NUMERIC_OPTIONS), "question_id long, letter string, value string, unit string, keyword string")
    return answers.numeric_in_context(options, paragraphs(table(spark, sf, "documents")))


# ---- the pipeline with toggles

#: Least score of the toggled searches: the axes that stand for the questions' vectors are far from all points.
_LEAST = 0.25


def _hybrid_sql(on: bool) -> str:
    known = sql_list(lexicon.SYNONYMS)
    n = rf"least(3, 1 + 2 * len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(q), '\s+'), lambda w: regexp_replace(w, '[?.,!;:]$', '')), lambda w: list_contains({known}, w)))))" if on else "1"
    score = f"case when b.query_id = 5 then least(1.0, score + coalesce((select sum({_MATCH_SQL}) from m where m.doc_id = b.doc_id), 0) / 100) else score end" if on else "score"
    covered = lambda held: f"(case when len(ws) = 0 then 0.5 else len(list_filter(list_distinct(ws), lambda w: {held})) / len(ws) end)"
    head = f"""{_HITS}, {_MEASURED}, va as (select query_id, n, unnest(range(1, n + 1)) as rank from (select query_id, cast({n} as int) as n from q)),
    s as (select query_id, rank, n, vec_id as doc_id, round(list_cosine_similarity(list_transform(range(0, 64), lambda i: case when i = (query_id + rank) % 8 then 1.0::double else 0.0::double end), embedding::double[]), 6) as score from va, embeddings),
    t as (select *, row_number() over (partition by query_id, rank order by score desc, doc_id) as place from s where score >= {_LEAST} - case when n > 1 then 0.05 else 0 end),
    d as (select *, row_number() over (partition by query_id, doc_id order by rank, score desc) as first from t where place <= 10),
    v as (select query_id, doc_id, score, 0 as src, row_number() over (partition by query_id order by score desc, doc_id) as place from d where first = 1),
    w as (select query_id, doc_id, 0.45 as score, 1 as src, row_number() over (partition by query_id order by doc_id) as place from (select distinct query_id, doc_id from k)),
    u as (select query_id, doc_id, score, src from v where place <= 10 union all select query_id, doc_id, score, src from w where place <= 10),
    b as (select * from u qualify row_number() over (partition by query_id, doc_id order by src) = 1),
    x as (select b.query_id, b.doc_id, src, coalesce("text", '') as content, q, {score} as score from b join q using (query_id) join documents using (doc_id)),
    c as (select * from (select *, row_number() over (partition by query_id order by score desc, src, doc_id) as citation_index from x where score >= {_LEAST}) where citation_index <= 3)"""
    if not on:
        return f"with {head} select query_id, citation_index, doc_id, round(score, 6) as score, cast(floor(avg(score) over (partition by query_id) * 100 + 0.5) as bigint) as confidence from c"
    return f"""with {head},
    e as (select query_id, any_value(q) as q, avg(score) as mean, list(lower(content)) as ev from c group by query_id),
    f as (select *, {WORDS_SQL} as ws, lower(q) as t from e),
    g as (select query_id, {covered("len(list_filter(ev, lambda x: contains(x, w))) > 0")} as covered, {semantic_sql("q", lambda terms: "(len(list_filter(ev, lambda x: " + sqltext.contains_any("x", terms) + ")) > 0)")} as matched,
          {SCENARIO_CASES} as types, {SCENARIO_CONCEPTS} as concepts, {SCENARIO_ASKS} as asks, floor(mean * 100 + 0.5) as original from f),
    y as (select *, types + case when concepts > 1 then concepts else 0 end + asks as complexity, types + case when concepts > 1 then 1 else 0 end as n_types from g),
    i as (select query_id, complexity >= 2 or n_types >= 2 as practical, cast(case when complexity >= 2 or n_types >= 2 then least(100, floor(original * 0.4 + covered * 30 + matched * 30 + 0.5) + case when covered > 0.7 then 5 else 0 end + case when matched > 0.7 then 5 else 0 end + case when complexity > 3 then 3 else 0 end) else original end as bigint) as confidence from y),
    j as (select c.*, practical, confidence, {WORDS_SQL} as ws from c join i using (query_id)),
    l as (select *, case when practical then round(score * 0.5 + {covered("contains(lower(content), w)")} * 0.3 + {semantic_sql("q", lambda terms: sqltext.contains_any("content", terms))} * 0.2, 6) else 0 end as combined from j)
    select query_id, row_number() over (partition by query_id order by combined desc, citation_index) as citation_index, doc_id, round(score, 6) as score, confidence from l"""


def hybrid_search(spark: SparkSession, sf: str, toggles: hybrid.Toggles, log: hybrid.StepLog) -> DataFrame:
    asked, docs = questions(spark), table(spark, sf, "documents").select("doc_id", "text")
    vectors = asked.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("rank"))
    vectors = vectors.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.pmod(F.col("query_id") + F.col("rank"), F.lit(8)), 1.0).otherwise(0.0)))
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return hybrid.search(asked, vectors, points, docs, trigrams.open_index(docs, sf), toggles, log)


@query("hybrid_all_on", _hybrid_sql(True))
def hybrid_all_on(spark: SparkSession, sf: str) -> DataFrame:
    """Synonyms, both searches, numbers and the optimiser."""
    return hybrid_search(spark, sf, hybrid.Toggles(synonyms=True, numbers=True, optimizer=True, least=_LEAST), hybrid.StepLog())


@query("hybrid_base", _hybrid_sql(False))
def hybrid_base(spark: SparkSession, sf: str) -> DataFrame:
    """Both searches alone."""
    return hybrid_search(spark, sf, hybrid.Toggles(least=_LEAST), hybrid.StepLog())
