"""Queries of question understanding, clarification, references and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import confidence, lexicon, text
from docengine.operators import dialogue
from docengine.operators import understanding as u
from docengine.plans.registry import query
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table

_LOW = "lower(coalesce(\"text\", ''))"


def _any(column: str, words) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").withColumn("said", F.coalesce("text", F.lit("")))


SCENARIO_CASES = " + ".join(f"case when {_any('t', w)} then 1 else 0 end" for w in lexicon.SCENARIOS.values())
SCENARIO_CONCEPTS = " + ".join(f"case when {_any('t', w)} then 1 else 0 end" for w in lexicon.CONCEPTS.values())
SCENARIO_ASKS = " + ".join(f"case when starts_with(t, '{w}') or contains(t, ' {w} ') then 0.5 else 0 end" for w in lexicon.QUESTION_WORDS)


@query(
    "practical_scenario",
    f"""with q as (select conv_id, turn, {_LOW} as t from conversations where role = 'user'),
    s as (select conv_id, turn, {SCENARIO_CASES} as types, {SCENARIO_CONCEPTS} as concepts, {SCENARIO_ASKS} as asks from q),
    r as (select conv_id, turn, cast(types + case when concepts > 1 then concepts else 0 end + asks as double) as complexity, cast(types + case when concepts > 1 then 1 else 0 end as bigint) as n_types from s)
    select *, complexity >= 2 or n_types >= 2 as is_practical from r""",
)
def practical_scenario(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf).select("conv_id", "turn", *[c.alias(n) for n, c in confidence.scenario(F.col("said")).items()])


_ACTION = "case " + " ".join(f"when regexp_matches({_LOW}, '{p}') then '{n}'" for p, n in u.ACTIONS) + " else 'informatii' end"


@query("chat_action", f"select conv_id, turn, {_ACTION} as action from conversations where role = 'user'")
def chat_action(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf).select("conv_id", "turn", u.action(F.col("said")).alias("action"))


def _subject_sql(x: str) -> str:
    for word in u.LEADING:
        x = rf"regexp_replace({x}, '^{word}\s*', '')"
    long = rf"list_filter(regexp_split_to_array(regexp_replace({x}, '[?.,!;:]', '', 'g'), '\s+'), lambda w: length(w) > 3)"
    return f"(case when len({long}) = 0 then 'instalatii electrice' else array_to_string({long}[1:2], ' ') end)"


_FACTS_SQL = "list_concat(regexp_extract_all(said, '(?i)\\d+\\s*(?:mm|mm²|A|tablouri|tablou|circuite)'), list_filter([" + ", ".join(f"case when contains({_LOW}, '{w}') then '{fact}' end" for w, fact in u.FACTS) + "], lambda f: f is not null))"
_SAID = "(select *, coalesce(\"text\", '') as said from conversations where role = 'user')"


@query("chat_subject", f"select conv_id, turn, {_subject_sql(_LOW)} as subject, array_to_string({_FACTS_SQL}, ';') as facts from {_SAID}".replace("\\\\", "\\"))
def chat_subject(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf).select("conv_id", "turn", u.subject(F.col("said")).alias("subject"), F.array_join(u.stated_facts(F.col("said")), ";").alias("facts"))


@query(
    "subject_drift",
    f"""with a as (select conv_id, turn, {_LOW} as t, lead({_LOW}) over (partition by conv_id order by turn) as answer, role from conversations),
    w as (select conv_id, turn, list_filter(string_split(t, ' '), lambda x: length(x) > 3)[1:5] as ws, answer from a where role = 'user' and answer is not null)
    select conv_id, turn, len(list_filter(ws, lambda x: contains(answer, x))) = 0 as drifts from w""",
)
def subject_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Does the answer hold none of the question's first long words?"""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", low.alias("t"), F.lead(low).over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
    rows = rows.where("role = 'user' and answer is not null").withColumn("ws", F.slice(F.filter(F.split("t", " "), lambda w: F.char_length(w) > 3), 1, 5))
    return rows.select("conv_id", "turn", (F.size(F.filter("ws", lambda w: F.contains("answer", w))) == 0).alias("drifts"))


_UNIVERSAL_SQL = " or ".join(f"contains(about, '{w}')" for w in u.UNIVERSAL)
_NEED_SQL = (
    f"case when ({_UNIVERSAL_SQL}) and regexp_matches(low, 'cum se|principii|reguli|general') then '{u.REASONS['universal']}' "
    + " ".join(f"when regexp_matches(low, '{p}') then '{u.REASONS['ambiguous'] + missing}'" for p, missing in u.AMBIGUOUS)
    + f" when length(said) < 20 and about = '' then '{u.REASONS['vague']}' else '{u.REASONS['enough']}' end"
)


@query(
    "clarification_need",
    f"""with s as (select conv_id, turn, said, {_LOW} as low, lower({_subject_sql(_LOW)}) as about from {_SAID}), r as (select conv_id, turn, {_NEED_SQL} as reason from s)
    select conv_id, turn, reason not in ('{u.REASONS['universal']}', '{u.REASONS['enough']}') as needed, reason from r""",
)
def clarification_need(spark: SparkSession, sf: str) -> DataFrame:
    need = u.clarification(F.col("said"), u.subject(F.col("said")), F.lit(None).cast("double"))
    return _users(spark, sf).select("conv_id", "turn", need.alias("c")).select("conv_id", "turn", "c.needed", "c.reason")


_CATEGORY = "case " + " ".join(f"when {_any('lower(p_name)', w)} then '{n}'" for w, n in u.CATEGORIES) + " else 'Legislație ANRE' end"


@query("file_category", f"select {_CATEGORY} as category, count(*) as n from part group by 1")
def file_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(u.file_category(F.col("p_name")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "document_profile",
    rf"""with t as (select doc_id, coalesce("text", '') || case when doc_id % 3 = 0 then ' Conform Art. 5, CAPITOLUL 2' when doc_id % 3 = 1 then ' normativ Art. 7' else '' end as t from documents),
    r as (select doc_id, case when regexp_matches(t, '(?i)\b(trebuie|obligatoriu|conform|normativ|tehnic)\b') and regexp_matches(t, 'Art\.\s*\d+') and regexp_matches(t, '(?i)CAPITOLUL\s+\d+') then 'romanian-legal-norm' when doc_id % 7 = 0 then 'scanned-pdf' else 'generic-document' end as profile from t)
    select doc_id, r.profile, chunk_size, overlap from r join (values {", ".join(f"('{n}', {c}, {o})" for n, c, o, _ in u.PROFILES)}) p(profile, chunk_size, overlap) on p.profile = r.profile""",
)
def document_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of each document with its chunk sizes; a third of the texts gets a norm's marks, some are scans."""
    profiles = F.broadcast(spark.createDataFrame([(n, s, o) for n, s, o, _ in u.PROFILES], "profile string, chunk_size int, overlap int"))
    k = F.col("doc_id") % 3
    body = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " Conform Art. 5, CAPITOLUL 2").when(k == 1, " normativ Art. 7").otherwise(""))
    mime = F.when(F.col("doc_id") % 7 == 0, "image/png").otherwise("text/plain")
    docs = table(spark, sf, "documents").select("doc_id", u.best_profile(body, mime).alias("profile"))
    return docs.join(profiles, "profile")


@query("embedding_cost", "select cast(ceil(sum(n_chars) / 4) as bigint) as tokens, round(ceil(sum(n_chars) / 4) / 1000000 * 0.02, 9) as cost_usd from documents")
def embedding_cost(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "documents").agg(F.sum("n_chars").alias("chars"))
    out = u.embedding_cost(F.lit(1), F.col("chars"), "text-embedding-3-small")
    return sums.select(out["tokens"].alias("tokens"), F.round(out["cost_usd"], 9).alias("cost_usd"))


@query(
    "display_references",
    f"with {PARAGRAPHS_SQL} select doc_id, paragraph_number, '[' || paragraph_number || '] ' || source || case when paragraph_number % 3 = 0 then ', Art. ' || doc_id else ', pag. 1, parag. ' || paragraph_number end as reference from p join documents using (doc_id)",
)
def display_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = paragraphs(docs).join(docs.select("doc_id", "source"), "doc_id")
    article = F.when(F.col("paragraph_number") % 3 == 0, F.col("doc_id").cast("string"))
    return rows.select("doc_id", "paragraph_number", u.display_reference(F.col("paragraph_number"), F.col("source"), F.lit(1), F.col("paragraph_number"), article).alias("reference"))


@query("citation_gates", "select doc_id, n_chars % 101 >= 85 as strict, n_chars % 101 >= 70 as lax, n_chars % 101 >= 90 as high from documents")
def citation_gates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in u.citation_gates(F.col("n_chars") % 101).items()])


@query(
    "intent_rerank",
    f"""with {PARAGRAPHS_SQL}, s as (select doc_id, paragraph_number, least(1.0, round(length(content) % 50 / 100 + 0.3, 6) + case when regexp_matches(lower(content), '(^|[^A-Za-z0-9_])(that|with)($|[^A-Za-z0-9_])') then 0.15 else 0 end) as score from p),
    r as (select doc_id, paragraph_number, round(score, 6) as score, row_number() over (partition by doc_id order by round(score, 6) desc, paragraph_number) as rank from s)
    select * from r where rank <= 3""",
)
def intent_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of the wanted kind move up."""
    base = F.round(F.char_length("content") % 50 / 100 + 0.3, 6)
    wanted = text.classify(F.col("content"), ("that", "with"))["is_obligation"]
    rows = paragraphs(table(spark, sf, "documents")).withColumn("score", F.round(F.least(F.lit(1.0), base + F.when(wanted, 0.15).otherwise(0.0)), 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "paragraph_number")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("doc_id", "paragraph_number", "score", "rank")


@query(
    "retrieval_fallback",
    f"""with {PARAGRAPHS_SQL}, v as (select doc_id, paragraph_number, 0.5 as score, 0 as source_rank from p where contains(lower(content), 'that the')),
    few as (select count(*) < 3 or not exists (select 1 from p where contains(lower(content), 'that the') and contains(lower(content), 'priza')) as more from v),
    k as (select doc_id, paragraph_number, 0.35 as score, 1 as source_rank from p, few where more and contains(lower(content), 'with') order by doc_id, paragraph_number limit 10),
    d as (select *, row_number() over (partition by doc_id, paragraph_number order by source_rank) as n from (select * from v union all select * from k))
    select doc_id, paragraph_number, round(score, 6) as score from d where n = 1""",
)
def retrieval_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits join the vector hits where these are few or miss the key terms."""
    p = paragraphs(table(spark, sf, "documents"))
    near = p.where(text.contains_any(F.col("content"), ("that the",))).withColumns({"score": F.lit(0.5), "source_rank": F.lit(0)})
    more = near.agg(((F.count("*") < 3) | (F.coalesce(F.max(F.contains(F.lower("content"), F.lit("priza"))), F.lit(False)) == F.lit(False))).alias("more"))
    held = p.where(text.contains_any(F.col("content"), ("with",))).orderBy("doc_id", "paragraph_number").limit(10).join(F.broadcast(more)).where("more")
    both = near.unionByName(held.drop("more").withColumns({"score": F.lit(0.35), "source_rank": F.lit(1)}))
    w = Window.partitionBy("doc_id", "paragraph_number").orderBy("source_rank")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "paragraph_number", F.round("score", 6).alias("score"))


@query(
    "answer_sections",
    r"""with a as (select conv_id, turn, string_split(coalesce("text", ''), chr(10)) as lines from conversations where role = 'assistant'),
    l as (select conv_id, turn, unnest(lines) as s, unnest(range(0, len(lines))) as pos from a),
    k as (select *, case when regexp_matches(s, '^#+\s|^\*\*[^*]+\*\*:?$') then 'title' when regexp_matches(s, '^\s*[">„]') then 'quote' when regexp_matches(s, '(?i)important|atentie|interzis|obligatoriu') then 'important' else 'normal' end as kind from l),
    b as (select *, case when lag(kind) over (partition by conv_id, turn order by pos) = kind then 0 else 1 end as starts from k),
    g as (select *, sum(starts) over (partition by conv_id, turn order by pos) as section from b)
    select conv_id, turn, cast(section as bigint) as section, kind, count(*) as lines from g group by all""",
)
def answer_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of lines of one kind in the assistants' answers."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(u.answer_sections(lines)).alias("at", "kind"))
    w = Window.partitionBy("conv_id", "turn").orderBy("at")
    rows = rows.withColumn("starts", F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1))
    rows = rows.withColumn("section", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "turn", "section", "kind").agg(F.count("*").alias("lines"))


# ---- the state of a dialogue

_ADDED_SQL = "list_concat(list_filter([" + ", ".join(f"case when contains(lower(said), '{w}') then '{fact}' end" for w, fact in u.FACTS if w != "exterior") + r"], lambda f: f is not null), regexp_extract_all(said, '(?i)\d+\s*(?:mm|mm²|A|tablouri|tablou)'))"
_STATED_SQL = "list_concat(" + r"regexp_extract_all(said, '(?i)\d+\s*(?:mm|mm²|A|tablouri|tablou|circuite)'), list_filter([" + ", ".join(f"case when contains(lower(said), '{w}') then '{fact}' end" for w, fact in u.FACTS) + "], lambda f: f is not null))"
_WANTED_SQL = "case " + " ".join(f"when regexp_matches(lower(said), '{p}') then '{n}'" for p, n in u.ACTIONS) + " else 'informatii' end"


@query(
    "dialogue_state",
    f"""with b as (
        select conv_id, turn, role = 'user' as is_user, coalesce("text", '') as said, role = 'assistant' and length(coalesce("text", '')) % 3 = 0 as asks from conversations where role in ('user', 'assistant')
    ), p as (
        select *, row_number() over w as place, sum(cast(is_user as int)) over w - cast(is_user as int) as stretch,
               last_value(case when is_user then said end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as pending
        from b window w as (partition by conv_id order by turn)
    ), q as (select *, stretch > 0 and bool_or(asks) over (partition by conv_id, stretch) as waiting from p),
    n as (
        select *, not (place > 1 and (waiting or length(said) < {dialogue.SHORT} or {" or ".join(f"contains(lower(said), '{w}')" for w in u.FOLLOW_UP)})) as fresh, {_subject_sql("lower(said)")} as about_own, {_WANTED_SQL} as wanted_own
        from q where is_user
    ), i as (select *, sum(cast(fresh as int)) over (partition by conv_id order by turn) as intent, case when fresh then {_STATED_SQL} else {_ADDED_SQL} end as own from n),
    g as (
        select *, first_value(about_own) over w as about, first_value(wanted_own) over w as wanted, flatten(list(own) over w) as raw from i window w as (partition by conv_id, intent order by turn)
    ), f as (select *, list_filter(raw, lambda x, k: list_position(raw, x) = k) as facts from g)
    select conv_id, turn, case when waiting then 'clarification' when fresh then 'new' else 'follow_up' end as kind, case when intent > 0 then about end as subject, case when intent > 0 then wanted end as action,
           case when intent > 0 then array_to_string(facts, ';') else '' end as facts, sha256(case when waiting then pending || chr(10) || chr(10) || 'Detalii suplimentare: ' || said else said end) as combined_sha,
           sha256(case when intent > 0 then array_to_string(list_concat([wanted, about], facts, [said]), ' ') else said end) as focused_sha
    from f""",
)
def dialogue_state(spark: SparkSession, sf: str) -> DataFrame:
    """Subject, action and facts at every user's message; an assistant's message whose length three divides counts as a question back."""
    turns = table(spark, sf, "conversations").withColumn("asks", F.char_length(F.coalesce("text", F.lit(""))) % 3 == 0)
    out = dialogue.dialogue(turns)
    return out.select("conv_id", "turn", "kind", "subject", "action", F.array_join("facts", ";").alias("facts"), F.sha2("combined", 256).alias("combined_sha"), F.sha2("focused", 256).alias("focused_sha"))
