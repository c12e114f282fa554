"""Queries over web pages, tables in texts and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import numeric, spans
from docengine.functions.text import words_of
from docengine.operators import answers, patterns, quiz, tables
from docengine.plans.registry import query
from docengine.sources import shared, sinks, web
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table

_LINKS = r"""h as (select page_id, url as base, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1))) as href from pages),
    l as (select distinct page_id, case when regexp_matches(href, '^[a-z]+://') then href when starts_with(href, '//') then 'https:' || href
        when starts_with(href, '/') then regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || href else regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || '/' || href end as url
        from h where href <> '' and not starts_with(href, '#'))"""


@query("page_links", f"with {_LINKS} select page_id, url from l")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return web.page_links(table(spark, sf, "pages"))


@query("link_files", rf"with {_LINKS} select page_id, regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '[^A-Za-z0-9._\-]', '_', 'g') as filename, lower(regexp_extract(url, '\.([A-Za-z0-9]{{1,5}})(?:[?#].*)?$', 1)) as extension, count(*) as n from l group by all")
def link_files(spark: SparkSession, sf: str) -> DataFrame:
    links = web.page_links(table(spark, sf, "pages"))
    return links.groupBy("page_id", web.file_name(F.col("url")).alias("filename"), web.extension(F.col("url")).alias("extension")).agg(F.count("*").alias("n"))


@query("extension_histogram", rf"with {_LINKS} select lower(regexp_extract(url, '\.([A-Za-z0-9]{{1,5}})(?:[?#].*)?$', 1)) as extension, count(*) as n from l group by 1")
def extension_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return web.page_links(table(spark, sf, "pages")).groupBy(web.extension(F.col("url")).alias("extension")).agg(F.count("*").alias("n"))


@query("page_anchors", r"""with a as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) as a from pages)
    select page_id, regexp_extract(a, 'href="([^"]*)"', 1) as href, substr(trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' '), 1, 100) as title from a""")
def page_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return web.anchors(table(spark, sf, "pages"))


@query("text_urls", r"""select page_id, unnest(regexp_extract_all(coalesce(url, '') || ' ' || coalesce(html, ''), 'https?://[^\s"<>]+')) as url from pages""")
def text_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(web.urls_in_text(F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("html", F.lit(""))))).alias("url"))


@query("navigation_links", f"with {_LINKS} select page_id, count(*) as n from l where url like '%.example.%' and not contains(url, '/and') group by page_id")
def navigation_links(spark: SparkSession, sf: str) -> DataFrame:
    links = web.page_links(table(spark, sf, "pages")).where(F.col("url").like("%.example.%") & ~F.contains("url", F.lit("/and")))
    return links.groupBy("page_id").agg(F.count("*").alias("n"))


#: The tables' own link graph: each supplier's nation leads to its region, each customer's nation to its customers.
_EDGES_SQL = """e(src, dst) as (select 'r' || r_regionkey, 'n' || n_nationkey from region join nation on n_regionkey = r_regionkey
    union all select 'n' || s_nationkey, 's' || s_suppkey from supplier union all select 's' || (p_partkey % 100 + 1), 'p' || p_partkey from part)"""


@query("crawl_frontier", f"with recursive {_EDGES_SQL}, c(node, depth) as (select 'r0', 0 union select e.dst, depth + 1 from c join e on e.src = c.node) select node, min(depth) as depth from c group by node")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return web.crawl(tree_edges(spark, sf), spark.createDataFrame([("r0",)], "node string"))


_SITE_SQL = rf"""{_LINKS}, s as (select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root from pages),
    e(src, dst) as (select distinct root, url from s union select distinct s.url, l.url from l join s using (page_id) union select distinct l.url, regexp_extract(l.url, '^([a-z]+://[^/?#]+)', 1) from l)"""


def _site_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links of the pages' sites and the sites' roots: a root leads to its pages, a page to its links, a link to the root of its site."""
    pages, root = table(spark, sf, "pages"), lambda url: F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
    links = web.page_links(pages).withColumnRenamed("url", "dst")
    edges = pages.select(root("url").alias("src"), F.col("url").alias("dst"))
    edges = edges.unionByName(links.join(pages.select("page_id", F.col("url").alias("src")), "page_id").select("src", "dst")).unionByName(links.select(F.col("dst").alias("src"), root("dst").alias("dst")))
    return edges.distinct(), pages.select(root("url").alias("node")).distinct()


@query("page_crawl", f"with recursive {_SITE_SQL}, f as (select min(root) as root from s), c(node, depth) as (select root, 0 from f union select e.dst, depth + 1 from c join e on e.src = c.node where depth < 6) select node, min(depth) as depth from c group by node")
def page_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """A breadth-first crawl over the pages from the first site's root, until nothing new is found."""
    edges, roots = _site_edges(spark, sf)
    return web.crawl(shared.saved(edges, "edges"), roots.agg(F.min("node").alias("node")), save=lambda df: shared.saved(df, "crawl"))


@query(
    "page_paths",
    f"""with {_SITE_SQL}, r as (select distinct root from s), p as (
        select root, root as node, root as path from r union all
        select root, dst, root || ' > ' || dst from r join e on src = root union all
        select root, b.dst, root || ' > ' || a.dst || ' > ' || b.dst from r join e a on a.src = root join e b on b.src = a.dst)
    select root, node, path, row_number() over (partition by root order by path) as place from p""",
)
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The ways from each site's root to its pages and their links, in the order in which a depth-first walk meets them."""
    edges, roots = _site_edges(spark, sf)
    found = web.crawl_paths(shared.saved(edges, "edges"), roots, 2).withColumn("root", F.substring_index("path", " > ", 1))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path")).cast("long")).select("root", "node", "path", "place")


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(table(spark, sf, "supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")))
    return edges.unionByName(table(spark, sf, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 100 + 1).cast("string")).alias("src"), key("p", "p_partkey").alias("dst")))


@query("table_rows", rf"""with {PARAGRAPHS_SQL}, c as (select doc_id, paragraph_number, list_filter(list_transform(case when contains(content, chr(9)) then string_split(content, chr(9)) when regexp_matches(content, '\s{{3,}}') then regexp_split_to_array(content, '\s{{3,}}') else string_split(content, '|') end, lambda x: trim(x, ' ')), lambda x: x <> '') as cells from p where contains(content, '|'))
    select doc_id, paragraph_number, len(cells) as n_cells, array_to_string(cells[1:3], ';') as firsts from c""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents")).where(F.contains("content", F.lit("|"))).withColumn("cells", tables.columns_of(F.col("content")))
    return p.select("doc_id", "paragraph_number", F.size("cells").cast("long").alias("n_cells"), F.array_join(F.slice("cells", 1, 3), ";").alias("firsts"))


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    """The captioned tables of all documents and, as plain text, all pages (their ids below zero), planted ones behind each."""
    pages = table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ").alias("text"))
    texts = table(spark, sf, "documents").select("doc_id", "text").unionByName(pages)
    return tables.extract(texts.select("doc_id", tables.with_planted(F.col("text"), F.pmod("doc_id", F.lit(9)) + 1).alias("text")))


def _columns_sql(x: str) -> str:
    """``tables.columns_of``."""
    cut = rf"case when contains({x}, chr(9)) then string_split({x}, chr(9)) when regexp_matches({x}, '\s{{3,}}') then regexp_split_to_array({x}, '\s{{3,}}') when contains({x}, '|') then string_split({x}, '|') else regexp_split_to_array({x}, '\s{{2,}}') end"
    return f"list_filter(list_transform({cut}, lambda c: trim(c, ' ')), lambda c: c <> '')"


_BLANKS_SQL = "' ' || chr(9) || chr(13) || chr(12)"
_DATA_SQL = rf"(regexp_matches(x, '\d') or contains(x, chr(9)) or regexp_matches(x, '\s{{3,}}')) and len({_columns_sql('x')}) >= 2"
_SHORT_SQL = f"length(x) < {tables.HEADER_CHARS} and regexp_matches(x, '[A-ZĂÎȘȚÂ]')"
_TABLES_SQL = f"""given as (
        select doc_id, "text" from documents union all select -page_id - 1, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') from pages
    ), planted as (select doc_id, coalesce("text", '') || replace('{tables.PLANTED.replace(chr(10), "' || chr(10) || '").replace(chr(9), "' || chr(9) || '")}', '{{n}}', cast((doc_id % 9 + 9) % 9 + 1 as varchar)) as body from given),
    found as (select doc_id, body, regexp_extract_all(body, '{tables.BLOCK}') as bs, regexp_split_to_array(body, '{tables.BLOCK}') as gaps from planted),
    each as (select doc_id, body, bs[k] as block, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(bs[1:k - 1], lambda g: length(g))), 0) as start from found, range(1, len(bs) + 1) as r(k)),
    named as (
        select doc_id, block, 'Tabelul ' || regexp_extract(block, '{tables.BLOCK}', 1) as table_number, regexp_extract_all(substr(body, 1, cast(start as bigint)), '{tables.PAGE}', 1) as marks, start,
               trim(regexp_extract(block, '{tables.TITLE}', 1), {_BLANKS_SQL}) as t
        from each
    ), titled as (select *, case when t = '' then 'Tabel ' || table_number else t end as title, cast(coalesce(cast(marks[-1] as bigint), start // {tables.PAGE_CHARS} + 1) as bigint) as page_number from named),
    lined as (select *, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x, {_BLANKS_SQL})), lambda x: x <> '' and not regexp_matches(x, '{tables.CAPTION}') and x <> title) as lines from titled),
    placed as (select *, list_position(list_transform(lines, lambda x: not ({_SHORT_SQL}) and {_DATA_SQL}), true) as first from lined),
    cut as (
        select *, flatten(list_transform(list_filter(case when first > 0 then lines[1:first - 1] else lines end, lambda x: {_SHORT_SQL}), lambda x: {_columns_sql("x")})) as own,
               list_transform(list_filter(case when first > 0 then lines[first:] else [] end, lambda x: {_DATA_SQL}), lambda x: {_columns_sql("x")}) as rows_
        from placed
    ), tabs as (
        select doc_id, table_number, title, page_number, case when len(own) > 0 then own else list_transform(range(1, case when len(rows_) > 0 then len(rows_[1]) else 2 end + 1), lambda i: 'Coloana ' || i) end as headers,
               rows_, substr(block, 1, {tables.RAW_CHARS}) as raw_text
        from cut
    )"""

#: What is asked of the tables.
TABLE_QUERIES = ((1, "tabelul 3.1"), (2, "sectiunea conductoarelor"), (3, "curent cupru 16 valoare"))


@query(
    "table_extract",
    f"""with {_TABLES_SQL} select doc_id, table_number, title, page_number, array_to_string(headers, ';') as headers, array_to_string(list_transform(rows_, lambda r: array_to_string(r, ';')), chr(10)) as "rows", sha256(raw_text) as raw_sha from tabs""",
)
def table_extract(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "\n")
    return _tables(spark, sf).select("doc_id", "table_number", "title", "page_number", F.array_join("headers", ";").alias("headers"), lines.alias("rows"), F.sha2("raw_text", 256).alias("raw_sha"))


@query(
    "table_search",
    rf"""with {_TABLES_SQL}, q(query_id, low) as (values {", ".join(f"({i}, '{t}')" for i, t in TABLE_QUERIES)}),
    w as (select *, list_filter(regexp_split_to_array(low, '\s+'), lambda x: length(x) > 2) as ws from q),
    s as (
        select query_id, doc_id, table_number, title, page_number, raw_text,
               case when contains(lower(table_number), low) then 50 else 0 end + case when contains(lower(title), low) then 30 else 0 end
               + 10 * coalesce(list_sum(list_transform(headers, lambda h: len(list_filter(ws, lambda x: contains(lower(h), x))))), 0)
               + 5 * coalesce(list_sum(list_transform(flatten(rows_), lambda h: len(list_filter(ws, lambda x: contains(lower(h), x))))), 0)
               + case when contains(lower(raw_text), low) then 3 else 0 end as score
        from tabs, w
    ), r as (select *, row_number() over (partition by query_id order by score desc, doc_id, table_number, page_number, raw_text) as rank from s where score > 0)
    select cast(query_id as bigint) as query_id, doc_id, table_number, title, cast(score as bigint) as score, rank from r where rank <= 10""",
)
def table_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame(list(TABLE_QUERIES), "query_id long, query string")
    return tables.search(_tables(spark, sf), asked).select("query_id", "doc_id", "table_number", "title", "score", "rank")


@query(
    "table_lookup",
    rf"""with {_TABLES_SQL}, n as (select *, list_position(list_transform(headers, lambda h: contains(lower(h), 'sectiune')), true) as at_ from tabs where regexp_replace(lower(table_number), '\s', '', 'g') = 'tabelul3.1'),
    v as (select *, list_filter(list_transform(list_filter(rows_, lambda r: len(list_filter(r, lambda c: contains(lower(c), '16'))) > 0), lambda r: case when at_ > 0 and at_ <= len(r) then r[at_] else list_filter(r, lambda c: not contains(lower(c), '16'))[1] end), lambda x: x is not null) as vs from n)
    select doc_id, table_number, page_number, case when at_ > 0 then vs[1] end as "value", v2 as other from v, lateral (select list_filter(list_transform(list_filter(rows_, lambda r: len(list_filter(r, lambda c: contains(lower(c), 'priza'))) > 0), lambda r: list_filter(r, lambda c: not contains(lower(c), 'priza'))[1]), lambda x: x is not null)[1] as v2)""",
)
def table_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A value by row and column, and one by its row alone."""
    named = tables.cell(_tables(spark, sf), "tabelul 3.1", row="16", column="Sectiune")
    return tables.cell(named.withColumnRenamed("value", "by_column"), "Tabelul 3.1", row="priza").select("doc_id", "table_number", "page_number", F.col("by_column").alias("value"), F.col("value").alias("other"))


@query(
    "table_markdown",
    f"""with {_TABLES_SQL}, n as (select t.*, coalesce(d.source, '-') as document_name from tabs t left join documents d using (doc_id))
    select doc_id, table_number, sha256('**' || table_number || '**' || chr(10) || title || chr(10) || '📄 Pagina ' || page_number || ' din ' || document_name || chr(10) || chr(10) ||
        case when len(rows_) = 0 then substr(raw_text, 1, 500) || '...' || chr(10) else '| ' || array_to_string(headers, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(headers, lambda h: '---'), '|') || '|' || chr(10)
        || array_to_string(list_transform(rows_[1:20], lambda r: '| ' || array_to_string(r, ' | ') || ' |' || chr(10)), '') end) as shown_sha from n""",
)
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("document_name"))
    named = _tables(spark, sf).join(names, "doc_id", "left").withColumn("document_name", F.coalesce("document_name", F.lit("-")))
    return named.select("doc_id", "table_number", F.sha2(tables.display(), 256).alias("shown_sha"))


@query("status_report", "select '| status | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderstatus || ' | ' || n || ' |', chr(10) order by o_orderstatus) as markdown from (select o_orderstatus, count(*) as n from orders group by 1)")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return sinks.markdown_table(counts, ["status", "n"])


#: Forms of a quiz text by a part's size: options by line, in one line, two only, none.
_QUIZ_FORMS = ("{stem}\na) {a}\nb) {b}\nc) {c}", "{stem} A. {a} B. {b} C. {c}", "{stem}\na) {a}\nb) {b}", "{stem}")


@query(
    "quiz_detect",
    """with p as (select p_partkey as question_id, p_size % 4 as form, 'Care este marimea piesei ' || p_name || case when p_partkey % 2 = 0 then '?' else '' end as stem, p_size || ' mm' as a, p_brand as b, lower(p_type) as c from part),
    o as (select question_id, stem, form, case when form < 3 then a end as option_a, case when form < 3 then b end as option_b, case when form < 2 then c end as option_c from p)
    select question_id, stem, option_a, option_b, option_c, round(case form when 0 then 1.0 when 1 then 1.0 when 2 then 0.5 else 0 end + 0.1 + case when stem like '%?' then 0.1 else 0 end, 2) as score, form < 2 as is_quiz from o""",
)
def quiz_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts, one for each part, are a quiz, and their options."""
    parts = table(spark, sf, "part")
    stem = F.concat(F.lit("Care este marimea piesei "), "p_name", F.when(F.col("p_partkey") % 2 == 0, "?").otherwise(""))
    given = {"stem": stem, "a": F.concat(F.col("p_size").cast("string"), F.lit(" mm")), "b": F.col("p_brand"), "c": F.lower("p_type")}
    form = F.get(F.array(*[answers.fill(f, **given) for f in _QUIZ_FORMS]), (F.col("p_size") % 4).cast("int"))
    return quiz.detect(parts.select(F.col("p_partkey").alias("question_id"), form.alias("text")))


@query("quiz_numeric")
def quiz_numeric(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(table(spark, sf, "documents"))
    return quiz.numeric_answers(quiz.sample_questions(spark), p.select(F.xxhash64("doc_id", "paragraph_number").alias("evidence_id"), "content"))


@query(
    "quiz_keyword",
    rf"""with {PARAGRAPHS_SQL}, o(question_id, letter, opt) as (values {quiz.OPTION_VALUES}),
    w as (select question_id, letter, list_distinct(list_filter(string_split(lower(opt), ' '), lambda x: length(x) > 3)) as ws from o),
    s as (select question_id, letter, cast(sum(len(list_filter(ws, lambda x: contains(lower(content), x)))) as bigint) as score from p, w group by all),
    r as (select *, score - lead(score) over (partition by question_id order by score desc, letter) as margin, row_number() over (partition by question_id order by score desc, letter) as n from s)
    select cast(question_id as bigint) as question_id, letter, score, margin from r where n = 1""",
)
def quiz_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """The option whose words the whole corpus holds most often, with its lead over the next."""
    words = F.array_distinct(F.filter(words_of(F.lower("option")), lambda w: F.char_length(w) > 3))
    options = quiz.options(quiz.sample_questions(spark)).select("question_id", "letter", F.explode_outer(words).alias("pattern"))
    found = patterns.count_patterns(paragraphs(table(spark, sf, "documents")), F.lower("content"), options.select("pattern"))
    scored = options.join(found, "pattern", "left").groupBy("question_id", "letter").agg(F.coalesce(F.sum("n_texts"), F.lit(0)).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "letter")
    return scored.withColumns({"margin": F.col("score") - F.lead("score").over(w), "n": F.row_number().over(w)}).where("n = 1").drop("n")


def _part_options(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each part: is its size half a step more, the size itself, or its last digit in seconds?"""
    options = F.array(
        F.struct(F.lit("a").alias("letter"), F.concat(F.col("p_size").cast("string"), F.lit(",5 A")).alias("option")),
        F.struct(F.lit("b").alias("letter"), F.concat(F.col("p_size").cast("string"), F.lit(" a sau "), F.col("p_partkey").cast("string"), F.lit(" kV")).alias("option")),
        F.struct(F.lit("c").alias("letter"), F.concat((F.col("p_size") % 10).cast("string"), F.lit("sec")).alias("option")),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.explode(options).alias("o")).select("question_id", "o.*")


@query(
    "quiz_option_values",
    """with v as (
        select p_partkey as question_id, 'a' as letter, 'A' as unit, p_size || '.5' as "value", 0 as place from part
        union all select p_partkey, 'b', 'kV', cast(p_partkey as varchar), 0 from part union all select p_partkey, 'b', 'A', cast(p_size as varchar), 1 from part
        union all select p_partkey, 'c', 's', cast(p_size % 10 as varchar), 0 from part)
    select question_id, letter, unit, "value", cast(place as bigint) as place from v""",
)
def quiz_option_values(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers with units of all options, unit by unit."""
    return patterns.option_values(_part_options(spark, sf))


@query(
    "quiz_first_number",
    rf"""with {PARAGRAPHS_SQL}, low as (select distinct lower(content) as t from p), sizes as (select distinct p_size as n from part),
    v as (
        select n || '.5' as "value", 'A' as unit, '(' || n || '\.?5|' || n || ',5|' || (n + 1) || ')\s*a([^a-z0-9_]|$)' as re from sizes
        union all select cast(n as varchar), 'A', n || '\s*a([^a-z0-9_]|$)' from sizes
        union all select distinct cast(n % 10 as varchar), 's', (n % 10) || '(\s*s([^a-z0-9_]|$)|\s*sec)' from sizes
        union all select cast(p_partkey as varchar), 'kV', p_partkey || '\s*kv' from part
    ), digits as (select t from low where regexp_matches(t, '\d\s*(a([^a-z0-9_]|$)|s([^a-z0-9_]|$)|sec|kv)')),
    h as (select distinct "value", unit from v, digits where regexp_matches(t, re)),
    o as (
        select p_partkey as question_id, 'a' as letter, 0 as place, p_size || '.5' as "value", 'A' as unit from part
        union all select p_partkey, 'b', 0, cast(p_partkey as varchar), 'kV' from part union all select p_partkey, 'b', 1, cast(p_size as varchar), 'A' from part
        union all select p_partkey, 'c', 0, cast(p_size % 10 as varchar), 's' from part
    ), r as (select o.*, row_number() over (partition by question_id order by letter, place) as n from o join h using ("value", unit))
    select question_id, letter, "value", unit, cast({patterns.NUMERIC_CONFIDENCE} as bigint) as confidence from r where n = 1""",
)
def quiz_first_number(spark: SparkSession, sf: str) -> DataFrame:
    """The first option of each question whose number the documents hold with its unit."""
    return patterns.first_numeric_hit(_part_options(spark, sf), paragraphs(table(spark, sf, "documents")), F.col("content"))


#: Options of quizzes that hold terms of several categories; a part's name comes first.
_OPTION_TEXTS = ("zona protectie a unui post de transformare", "conductoare de cupru in tablou electric", "priză de pământ cu electrod vertical", "numai dispozitiv diferential de 30 mA", "corp de iluminat si lampa", "nimic")


@query(
    "quiz_keywords",
    "with p as (select p_partkey as option_id, strip_accents(lower(p_name || ' ' || ([" + ", ".join(f"'{t}'" for t in _OPTION_TEXTS) + f"])[p_size % {len(_OPTION_TEXTS)} + 1])) as t from part),"
    + " k as (select option_id, list_concat(list_transform(list_filter([" + ", ".join(f"['{c}', '{t}']" for c, terms in quiz.CATEGORIES for t in terms) + "], lambda x: contains(t, x[2])), lambda x: x[1] || ':' || x[2]),"
    + " list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) >= 5 and list_contains([" + ", ".join(f"'{w}'" for w in quiz.SIGNIFICANT) + "], w)), lambda w: 'word:' || w)) as ks from p)"
    + " select option_id, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i), ';') as keywords from k",
)
def quiz_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The categories' terms and significant words of each option."""
    said = F.get(F.array(*[F.lit(t) for t in _OPTION_TEXTS]), (F.col("p_size") % len(_OPTION_TEXTS)).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("option_id"), F.array_join(quiz.keywords(F.concat("p_name", F.lit(" "), said)), ";").alias("keywords"))


#: Questions about a quantity; ``{n}`` is filled in.
_QUANTITY_TEXTS = ("ce distanta de la perete, {n} mm", "inaltime de {n} cm", "sectiune de {n}", "curent de {n} A", "tensiune minim {n} V", "nimic")


@query(
    "measured_quantity",
    f"""with p as (select p_partkey as question_id, p_size % {len(_QUANTITY_TEXTS)} as k, p_partkey % 50 + 1 as n from part)
    select question_id, ['distance', 'height', 'section', 'current', 'voltage', null][k + 1] as quantity, case when k < 4 then cast(n as double) end as "value", ['mm', 'cm', 'mm²', 'a', 'v', null][k + 1] as unit from p""",
)
def measured_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """What a question measures, with its value and unit."""
    said = F.get(F.array(*[F.lit(t) for t in _QUANTITY_TEXTS]), (F.col("p_size") % len(_QUANTITY_TEXTS)).cast("int"))
    asked = F.replace(said, F.lit("{n}"), (F.col("p_partkey") % 50 + 1).cast("string"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), numeric.measured_quantity(asked).alias("q"))
    return rows.select("question_id", F.col("q.type").alias("quantity"), F.col("q.value").alias("value"), F.col("q.unit").alias("unit"))


#: Quantities in a sentence behind a text; ``{n}`` is filled in.
QUANTITIES = " densitate {n},5 A/mm² la 1{n} A, 0.{n} kV, {n}0 mm2 si {n} metri, {n}s, 4{n} grade C, {n}.2 MΩ, 2{n} ohmi, {n} V"
#: A bound without a unit, near a word of resistance and far from one.
BOUNDS = " priza de pamant are cel mult {n} : " + "x" * 120 + " cel mult 9{n} ;"
_QUANTITIES_SQL = """z as (select doc_id, coalesce("text", '') || replace('{said}', '{{n}}', cast((doc_id % 8 + 8) % 8 + 1 as varchar)) as t from documents)"""

#: The rules' patterns for an engine without look-around: what may not follow is taken along.
_RULES_SQL = (
    ("mm²", r"\s*(?:mm[²2]|mm\^2|mm\s*p\s*atrat)"),
    ("A/mm²", r"\s*(?:A\s*/\s*mm[²2]|A/mm\^2|A\s*pe\s*mm)"),
    ("kVA", r"\s*kVA"),
    ("kV", r"\s*kV(?:[^A]|$)"),
    ("V", r"\s*V(?:[^A-Za-z0-9_]|$)"),
    ("A", r"\s*A(?:[^A-Za-z0-9_.]|$)"),
    ("Ω", r"\s*(?:[ΩΩ]|ohmi?|ohms?)"),
    ("s", r"\s*s(?:[^A-Za-z0-9_]|$)"),
    ("m", r"\s*(?:m|metri?)(?:[^a-z²2]|$)"),
    ("°C", r"\s*(?:°C|grade\s*C)"),
    ("MΩ", r"\s*(?:M[ΩΩ]|Mohm|megaohmi?)"),
)


def _with_quantities(spark: SparkSession, sf: str, said: str) -> DataFrame:
    n = (F.pmod("doc_id", F.lit(8)) + 1).cast("string")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.replace(F.lit(said), F.lit("{n}"), n)).alias("t"))


@query(
    "unit_spans",
    f"with {_QUANTITIES_SQL.format(said=QUANTITIES)}, m as ("
    + " union all ".join(f"select doc_id, '{unit}' as unit, unnest(regexp_extract_all(t, '(?i)({spans.NUMBER}){tail}', 1)) as raw from z" for unit, tail in _RULES_SQL)
    + ") select doc_id, unit, count(*) as n, round(sum(cast(replace(raw, ',', '.') as double)), 6) as total from m group by doc_id, unit",
)
def unit_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with units by each rule's own reading, with what may not follow; a number may have several."""
    found = _with_quantities(spark, sf, QUANTITIES).select("doc_id", F.explode(spans.unit_spans(F.col("t"))).alias("s"))
    return found.groupBy("doc_id", "s.unit").agg(F.count("*").alias("n"), F.round(F.sum("s.value"), 6).alias("total"))


#: All rules as one pattern for an engine that takes the first fitting one: longer readings first.
_ONE_OF_SQL = "|".join(f"({tail})" for _, tail in sorted(_RULES_SQL, key=lambda r: ["A/mm²", "mm²", "kVA", "kV", "MΩ", "Ω", "°C", "m", "V", "A", "s"].index(r[0])))
_ONE_OF_UNITS = ["A/mm²", "mm²", "kVA", "kV", "MΩ", "Ω", "°C", "m", "V", "A", "s"]


@query(
    "resolved_quantities",
    f"""with {_QUANTITIES_SQL.format(said=QUANTITIES)}, h as (select doc_id, unnest(regexp_extract_all(t, '(?i){spans.NUMBER}(?:{_ONE_OF_SQL})')) as hit from z),
    m as (select doc_id, regexp_extract(hit, '^({spans.NUMBER})', 1) as raw, case {" ".join(f"when regexp_matches(hit, '(?i)^{spans.NUMBER}{dict(_RULES_SQL)[u]}$') then '{u}'" for u in _ONE_OF_UNITS)} end as unit from h)
    select doc_id, unit, count(*) as n, round(sum(cast(replace(raw, ',', '.') as double)), 6) as total from m group by doc_id, unit""",
)
def resolved_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with one unit each: of overlapping readings the earliest, the longest, the first rule."""
    found = _with_quantities(spark, sf, QUANTITIES).select("doc_id", F.explode(spans.resolved(spans.unit_spans(F.col("t")))).alias("s"))
    return found.groupBy("doc_id", "s.unit").agg(F.count("*").alias("n"), F.round(F.sum("s.value"), 6).alias("total"))


@query(
    "quiz_values",
    rf"""with {_QUANTITIES_SQL.format(said=BOUNDS)}, m as (select doc_id, unnest(regexp_extract_all(t, '(?i){spans.NUMBER}\s*(?:[ΩΩ]|ohms?|ohmi?|m|mm?[²2]|a|v|ma|kw|cm)')) as hit from z),
    v as (
        select doc_id, regexp_extract(hit, '^({spans.NUMBER})', 1) as raw, lower(regexp_extract(hit, '^{spans.NUMBER}\s*(.*)$', 1)) as u from m
        union all
        select doc_id_of, b, 'ω' from (select doc_id as doc_id_of, regexp_extract(t, '(?is)priza de pamant.{{0,60}}?cel\s+mult\s+({spans.NUMBER})\s*[:;]', 1) as b from z)
        where not exists (select 1 from m where m.doc_id = doc_id_of and regexp_matches(hit, '(?i)[ΩΩ]|ohm') and abs(cast(replace(regexp_extract(hit, '^({spans.NUMBER})', 1), ',', '.') as double) - cast(b as double)) < 0.1)
    ) select doc_id, case when u in ('ω', 'ohm', 'ohms', 'ohmi') then 'Ω' when u = 'mm2' then 'mm²' when u = 'm2' then 'm²' else u end as unit, count(*) as n, round(sum(cast(replace(raw, ',', '.') as double)), 6) as total from v group by 1, 2""",
)
def quiz_values(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with a quiz's units; a bound without one is a resistance where the words around it say so."""
    found = _with_quantities(spark, sf, BOUNDS).select("doc_id", F.explode(spans.quiz_values(F.col("t"))).alias("s"))
    return found.groupBy("doc_id", "s.unit").agg(F.count("*").alias("n"), F.round(F.sum("s.value"), 6).alias("total"))


@query(
    "quiz_answer_parse",
    "with t as (select conv_id * 1000 + turn as answer_id, ([" + ", ".join(f"'{a}'" for a in quiz.ANSWERS) + f"])[(conv_id + turn) % {len(quiz.ANSWERS)} + 1] || ' ' || coalesce(\"text\", '') as answer from conversations where role = 'assistant')"
    + " select answer_id, coalesce(" + ", ".join(f"nullif(lower(regexp_extract(answer, '{rule}', 1)), '')" for rule in quiz.ANSWER_RULES) + ") as letter from t",
)
def quiz_answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The letters that the assistants' messages name, behind one of some ways to say it."""
    said = F.get(F.array(*[F.lit(a) for a in quiz.ANSWERS]), ((F.col("conv_id") + F.col("turn")) % len(quiz.ANSWERS)).cast("int"))
    answers_ = table(spark, sf, "conversations").where("role = 'assistant'")
    return quiz.parse_answers(answers_.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("answer")))
