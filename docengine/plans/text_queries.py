"""Queries of ingest, query understanding, classification and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import lexicon, text
from docengine.operators import chunking
from docengine.plans.questions import QUESTION_VALUES, questions
from docengine.plans.registry import query, sql_list
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table

#: Words that the synthetic texts really hold, in place of the legal terms.
DATA_OBLIGATION, DATA_PROHIBITION, DATA_DEFINITION = ("that", "with"), ("from", "have"), ("this", "which")

_NORMAL = r"""trim(regexp_replace(regexp_replace(lower({0}), '[.,;:!?()"''\-\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"""
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def _word(terms) -> str:
    return r"(^|[^A-Za-z0-9_])(" + "|".join(terms) + r")($|[^A-Za-z0-9_])"


@query("paragraph_split", f"with {PARAGRAPHS_SQL} select doc_id, paragraph_number, length(content) as char_count, sha256(content) as content_sha from p")
def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    return p.select("doc_id", "paragraph_number", F.char_length("content").cast("long").alias("char_count"), F.sha2("content", 256).alias("content_sha"))


@query(
    "paragraph_pages",
    f"""with {PARAGRAPHS_SQL}, f as (
        select doc_id, list_reduce(parts, lambda a, x: a, '') as skip, parts,
               list_reduce(list_transform(parts, lambda x: {{'page': 1::bigint, 'chars': length(x)::bigint, 'pages': [1::bigint]}}),
                   lambda a, x: {{'page': case when a.chars + x.chars > 3000 then a.page + 1 else a.page end,
                                  'chars': case when a.chars + x.chars > 3000 then 0 else a.chars + x.chars end,
                                  'pages': list_append(a.pages, case when a.chars + x.chars > 3000 then a.page + 1 else a.page end)}},
                   {{'page': 1::bigint, 'chars': 0::bigint, 'pages': []::bigint[]}}).pages as pages
        from pp where len(parts) > 0)
    select doc_id, cast(unnest(range(1, len(parts) + 1)) as bigint) as paragraph_number, unnest(pages) as page_number from f""",
)
def paragraph_pages(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(table(spark, sf, "documents"), pages=True).select("doc_id", "paragraph_number", "page_number")


@query(
    "line_viewer",
    """select doc_id, cast(n as bigint) as line_number, line from (
        select doc_id, unnest(range(1, len(l) + 1)) as n, unnest(l) as line from (select doc_id, string_split(coalesce("text", ''), chr(10)) as l from documents)
    ) where trim(line, ' ') <> ''""",
)
def line_viewer(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return lines.where(F.trim("line") != "").select("doc_id", (F.col("n") + 1).cast("long").alias("line_number"), "line")


@query(
    "raw_text_join",
    f"with {PARAGRAPHS_SQL} select doc_id, sha256(string_agg(content, chr(10) || chr(10) order by paragraph_number)) as raw_sha, count(*) as n_paragraphs from p group by doc_id",
)
def raw_text_join(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_number", "content"))).alias("all"), F.count("*").alias("n_paragraphs"))
    return p.select("doc_id", F.sha2(F.array_join(F.transform("all", lambda x: x["content"]), "\n\n"), 256).alias("raw_sha"), "n_paragraphs")


@query("query_normalize", f"""select item_id, {_NORMAL.format('"text"')} as normalized from benchmark""")
def query_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.normalize_query(F.col("text")).alias("normalized"))


@query(
    "query_keywords",
    f"""select item_id, array_to_string(list_filter({_WORDS.format(_NORMAL.format('"text"'))}, lambda w: length(w) > 2 and not list_contains({sql_list(lexicon.QUERY_STOP)}, w)), ' ') as keywords from benchmark""",
)
def query_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "search_terms",
    r"""select item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower("text"), '[^A-Za-z0-9_\săîâșț]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)[1:5], ' ') as terms from benchmark""",
)
def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


_DATA_INTENTS = (("obligation", DATA_OBLIGATION), ("prohibition", DATA_PROHIBITION), ("definition", DATA_DEFINITION))


@query(
    "query_intent",
    f"""with n as (select item_id, {_NORMAL.format('"text"')} as t from benchmark)
    select item_id, case {' '.join(f"when regexp_matches(t, '{_word(w)}') then '{k}'" for k, w in _DATA_INTENTS)} else 'general' end as intent from n""",
)
def query_intent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.first_intent(text.normalize_query(F.col("text")), _DATA_INTENTS).alias("intent"))


@query(
    "route_intent",
    f"""select conv_id, turn, case {' '.join('when ' + ' or '.join(f"contains(lower(coalesce(\"text\", '')), '{t}')" for t in w) + f" then '{k}'" for k, w in (*lexicon.ROUTE_INTENTS, *_DATA_INTENTS))} else 'general' end as intent
    from conversations where role = 'user'""",
)
def route_intent(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", text.first_intent(F.coalesce("text", F.lit("")), (*lexicon.ROUTE_INTENTS, *_DATA_INTENTS), words=False).alias("intent"))


@query(
    "article_refs",
    r"""select doc_id, array_to_string(refs, ',') as refs, len(refs) as n_refs from (
        select doc_id, regexp_extract_all("text" || ' art. ' || doc_id || '.' || (doc_id % 7) || ' articol ' || (doc_id % 11), '(?i)art(?:icol)?\.?\s*(\d+[.\d]*)', 1) as refs from documents)""",
)
def article_refs(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.concat("text", F.lit(" art. "), "doc_id", F.lit("."), F.col("doc_id") % 7, F.lit(" articol "), F.col("doc_id") % 11)
    refs = table(spark, sf, "documents").select("doc_id", text.article_references(cited).alias("refs"))
    return refs.select("doc_id", F.array_join("refs", ",").alias("refs"), F.size("refs").cast("long").alias("n_refs"))


@query(
    "paragraph_classify",
    f"""with {PARAGRAPHS_SQL} select doc_id, paragraph_number, regexp_matches(lower(content), '{_word(DATA_OBLIGATION)}') as is_obligation,
    regexp_matches(lower(content), '{_word(DATA_PROHIBITION)}') as is_prohibition, regexp_matches(lower(content), '{_word(DATA_DEFINITION)}') as is_definition from p""",
)
def paragraph_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    return p.select("doc_id", "paragraph_number", *[c.alias(n) for n, c in text.classify(F.col("content"), DATA_OBLIGATION, DATA_PROHIBITION, DATA_DEFINITION).items()])


@query(
    "doc_keywords",
    rf"""select doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce("text", '')), '[^A-Za-z0-9_\s]', '', 'g'), '\s+'), lambda w: length(w) > 4 and not list_contains({sql_list(lexicon.DOCUMENT_STOP)}, w))[1:10], ' ') as keywords from documents""",
)
def doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.document_keywords(F.coalesce("text", F.lit(""))), " ").alias("keywords"))


@query(
    "document_totals",
    f"with {PARAGRAPHS_SQL} select d.doc_id, count(p.content) as paragraphs, cast(coalesce(sum(len({_WORDS.format('p.content')})), 0) as bigint) as n_words, count(p.content) > 0 as is_indexed from documents d left join p on p.doc_id = d.doc_id group by d.doc_id",
)
def document_totals(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    p = paragraphs(docs).select("doc_id", F.size(text.words_of(F.col("content"))).alias("n"))
    out = docs.select("doc_id").join(p, "doc_id", "left").groupBy("doc_id").agg(F.count("n").alias("paragraphs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"))
    return out.withColumn("is_indexed", F.col("paragraphs") > 0)


@query(
    "word_chunks",
    f"""with w as (select doc_id, {_WORDS.format('coalesce("text", chr(32))')} as w from documents), c as (
        select doc_id, w, unnest(range(0, len(w), 80)) as s from w where len(w) > 0)
    select doc_id, cast(s / 80 as bigint) as chunk_index, len(w[s + 1:s + 100]) as word_count, sha256(case when s > 0 then '[...] ' else '' end || array_to_string(w[s + 1:s + 100], ' ')) as content_sha from c""",
)
def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.word_chunks(table(spark, sf, "documents"), size=100, overlap=20)
    return c.select("doc_id", "chunk_index", "word_count", F.sha2("content", 256).alias("content_sha"))


@query(
    "char_chunks",
    r"""with t as (select doc_id, trim(regexp_replace(coalesce("text", ''), '\s+', ' ', 'g')) as t from documents), c as (select doc_id, t, unnest(range(0, length(t), 1400)) as s from t)
    select doc_id, cast(s / 1400 as bigint) as chunk_index, length(substr(t, s + 1, 1500)) as char_count, sha256(substr(t, s + 1, 1500)) as content_sha from c where length(substr(t, s + 1, 1500)) >= 200""",
)
def char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.char_chunks(table(spark, sf, "documents"), most=1500, least=200, overlap=100)
    return c.select("doc_id", "chunk_index", "char_count", F.sha2("content", 256).alias("content_sha"))


@query("sentence_chunks")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.folded_chunks(table(spark, sf, "documents"), unit="sentence")


@query("paragraph_chunks")
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.folded_chunks(table(spark, sf, "documents"), unit="paragraph", overlap=0)


@query("overlap_chunks")
def overlap_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.folded_chunks(table(spark, sf, "documents"), unit="paragraph")


@query("sentence_page_chunks")
def sentence_page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sentence_page_chunks(table(spark, sf, "documents"))


@query("index_chunks")
def index_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_previous_tail(chunking.folded_chunks(table(spark, sf, "documents"), unit="paragraph", most=1000, least=1, overlap=0), 200)


@query(
    "chunk_metadata",
    f"""with {PARAGRAPHS_SQL} select doc_id, paragraph_number, length(content) as char_count, len({_WORDS.format('content')}) as word_count,
    len(list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), lambda s: trim(s, ' ')), lambda s: s <> '')) as sentence_count from p""",
)
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    return p.select("doc_id", "paragraph_number", F.char_length("content").cast("long").alias("char_count"), F.size(text.words_of(F.col("content"))).cast("long").alias("word_count"), F.size(text.sentences(F.col("content"))).cast("long").alias("sentence_count"))


@query(
    "text_cleanup",
    r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(coalesce("text", ''), '([A-Za-z0-9_]+)-\s*\n\s*([A-Za-z0-9_]+)', '\1\2', 'g'), '\s+', ' ', 'g'))) as clean_sha from documents""",
)
def text_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.collapse_space(text.join_hyphens(F.coalesce("text", F.lit("")))), 256).alias("clean_sha"))


@query(
    "entity_decode",
    r"""select page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) as decoded_sha from pages""",
)
def entity_decode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(text.decode_entities(F.coalesce("html", F.lit(""))), 256).alias("decoded_sha"))


@query(
    "word_frequency",
    f"""select word, count(*) as n from (select unnest({_WORDS.format('lower("text")')}) as word from documents) group by word""",
)
def word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(text.words_of(F.lower("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


_VARIANT_QUERIES = tuple((i, q) for i, q in enumerate(("Unde se pune o priză langa tablou", "Ce cablu are circuit", "montaj ddr in tablou", "nimic de extins", "curent prin cablu si ddr", "protectie la circuit")))

#: Every user's message as a question: its first word and one of these, by conversation and turn.
VARIANTS_SQL = f"""q as (select conv_id * 1000 + turn as query_id, regexp_extract(coalesce("text", ''), '[A-Za-z]+') || ' ' || ([{', '.join(f"'{q}'" for _, q in _VARIANT_QUERIES)}])[(conv_id + turn) % {len(_VARIANT_QUERIES)} + 1] as q from conversations where role = 'user')"""


def variant_queries(spark: SparkSession, sf: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(q) for _, q in _VARIANT_QUERIES]), ((F.col("conv_id") + F.col("turn")) % len(_VARIANT_QUERIES)).cast("int"))
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0), F.lit(" "), said).alias("text"))


@query(
    "synonym_variants",
    f"""with {VARIANTS_SQL},
    d(term, k, syn) as (values {', '.join(f"('{t}', {k}, '{s}')" for t, ss in lexicon.SYNONYMS.items() for k, s in enumerate(ss))}),
    w as (select query_id, q, unnest(string_split(lower(q), ' ')) as word, unnest(range(1, len(string_split(q, ' ')) + 1)) as pos from q),
    t as (select query_id, q, word, min(pos) as pos from w where word in (select term from d) group by all),
    v as (select query_id, q as variant, -1 as pos, 0 as k from q union all
          select t.query_id, trim(replace(' ' || lower(t.q) || ' ', ' ' || t.word || ' ', ' ' || d.syn || ' '), ' '), t.pos, d.k from t join d on d.term = t.word),
    u as (select query_id, variant, min(pos * 10 + k) as o from v group by all),
    r as (select query_id, variant, row_number() over (partition by query_id order by o) as rank from u)
    select cast(query_id as bigint) as query_id, rank, variant from r where rank <= 6""",
)
def synonym_variants(spark: SparkSession, sf: str) -> DataFrame:
    from docengine.operators.retrieval import query_variants

    return query_variants(variant_queries(spark, sf))


@query(
    "best_sentence",
    f"""with d as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce("text", ''), '[.!?]+'), lambda s: trim(s, ' ')), lambda s: length(s) > 20) as ss from documents),
    s as (select doc_id, unnest(ss) as sentence, unnest(range(1, len(ss) + 1)) as k from d),
    q as (select query_id as item_id, {_WORDS.format('lower(q)')} as ws from (values {QUESTION_VALUES}) t(query_id, q)),
    x as (select item_id, doc_id, sentence, k, len(list_filter(list_filter(ws, lambda w: length(w) > 3), lambda w: contains(lower(sentence), w))) as score from s, q),
    r as (select *, row_number() over (partition by item_id, doc_id order by score desc, k) as n from x)
    select cast(item_id as bigint) as query_id, doc_id, cast(score as bigint) as score, sha256(sentence) as sentence_sha from r where n = 1""",
)
def best_sentence(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    q = questions(spark).select("query_id", F.filter(text.words_of(F.lower("text")), lambda w: F.char_length(w) > 3).alias("ws"))
    return chunking.best_sentences(docs, q)
