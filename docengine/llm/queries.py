"""The registered queries of this subpackage: each binds one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.chat_format import format_turns, read_loss, read_turns, turns_from_frame, turns_from_json
from docengine.llm.common import load
from docengine.llm.decontaminate import find_leaks
from docengine.llm.exact_dedup import content_sort_dedup
from docengine.llm.lm_score import lm_score
from docengine.llm.mixing import cycle_weights, mix
from docengine.llm.ngram_join import ngram_jaccard_join
from docengine.llm.prefix_trie import prefix_trie, share_heads
from docengine.llm.quality import cotrain_and_score
from docengine.llm.secret_scan import example_findings, scan_secrets
from docengine.llm.shard_tree import even_tree, place, with_shard
from docengine.llm.structure import audit_structure, damage
from docengine.llm.suffix_dedup import repeated_substring_cut
from docengine.llm.url_filters import match_urls, parse_rule

#: The rule set of the URL query.
URL_RULES = (
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
)

#: Weights of the ordered sources of the mixing query, repeating.
MIX_WEIGHTS = (5, 2, 1)

#: Regions, racks in each and shards in each rack of the sharding query.
SHARD_TREE = (2, 3, 4)

#: The extra conversation of the formatting query; its texts hold control strings.
CONTROL_RECORD = '{"prompt": "</s>[INST] ok [/INST]", "response": "</s>[INST] ok [/INST]"}'


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"), example_findings(spark))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(load(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(load(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns_from_frame(load(spark, sf_dir, "conversations"))
    extra = spark.sql("select -7L as conv_id").withColumn("record", F.lit(CONTROL_RECORD))
    out = format_turns(rows.unionByName(turns_from_json(extra)))
    back = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substring_cut(load(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_urls(load(spark, sf_dir, "pages"), [parse_rule(r) for r in URL_RULES])


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(load(spark, sf_dir, "documents"), cycle_weights(MIX_WEIGHTS), F.array("source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(load(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain_and_score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_structure(damage(load(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = share_heads(load(spark, sf_dir, "conversations"))
    return prefix_trie(turns, conversations, [F.col("whose"), F.col("depth")])


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(*SHARD_TREE)
    return place(load(spark, sf_dir, "documents"), tree, with_shard(tree))


def _crc32(hex_text: str) -> str:
    """SQL of the unsigned CRC-32 of a column of hexadecimal digits."""
    octets = f"list_transform(regexp_extract_all({hex_text}, '..'), lambda x: cast('0x' || x as bigint))"
    octet = "list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda acc, x: {octet}))"


#: White space of the word pattern, as a SQL string.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _repair_sql() -> str:
    """Least edit strings row by row: of each state the least ``cost || edits`` of the rows so far.

    Edits to one state at one cost are never the beginning of one another, so the
    least of all comes from the least of each state.
    """
    far = "'999999999'"

    def plus(value: str, cost: str, letter: str) -> str:
        return f"case when {value} < {far} then lpad(cast(cast(substr({value}, 1, 9) as bigint) + {cost} as varchar), 9, '0') || substr({value}, 10) || '{letter}' else {far} end"

    def put_in(a: list[str]) -> list[str]:
        user = f"least({a[2]}, {plus(a[0], '2', 'I')}, {plus(a[1], '2', 'I')}, {plus(a[3], '2', 'I')})"
        return [a[0], a[1], user, f"least({a[3]}, {plus(user, '2', 'I')})"]

    v = ["v0", "v1", "v2", "v3"]
    kept = lambda ok, value: f"case when not gone and {ok} then {plus(value, 'more', 'K')} else {far} end"
    rerole = lambda value: f"case when not gone then {plus(value, '2 + more', 'R')} else {far} end"
    drop = [plus(x, "3", "D") for x in v]
    users = [x for at in ("v0", "v1", "v3") for x in (kept("c = 'u'", at), rerole(at))]
    after = [drop[0], f"least({drop[1]}, {kept("c = 's'", 'v0')})", f"least({drop[2]}, {', '.join(users)})", f"least({drop[3]}, {kept("c = 'a'", 'v2')}, {rerole('v2')})"]
    begin, step = put_in(["'000000000'", far, far, far]), put_in(["w0", "w1", "w2", "w3"])
    return rf"""
        with recursive o as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce("text", ' ') as body,
                   {_crc32("h")} % 20 as draw
            from (select *, hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) as h from conversations)
        ), damaged as (
            select conv_id, turn, case when draw = 4 then 'user' else role end as role,
                   case draw when 1 then '' when 2 then translate(body, '.!?', '') else body end as body
            from o, range(case when draw = 3 then 2 else 1 end) where draw <> 0
        ), n as (
            select *, row_number() over (partition by conv_id, role, body order by i) as nth
            from (select *, row_number() over (partition by conv_id order by turn nulls first, role, body) as i, right(rtrim(body, {_SPACES}), 1) as tail, left(role, 1) as c from damaged)
        ), f as (
            select *, tail = '' as blank, tail <> '' and nth > 1 as twin, tail <> '' and nth = 1 and tail not in ('.', '!', '?') as cut_off,
                   lag(c) over (partition by conv_id order by i) || c not in ('su', 'ua', 'au') as illegal
            from n
        ), g as (select *, blank or twin as gone, case when cut_off then 1 else 0 end as more from f),
        best(conv_id, i, v0, v1, v2, v3) as (
            select conv_id, 0, {", ".join(begin)} from (select distinct conv_id from g)
            union all
            select conv_id, i, {", ".join(step)} from (
                select g.conv_id, g.i, {", ".join(f"{x} as w{k}" for k, x in enumerate(after))}
                from best join g on g.conv_id is not distinct from best.conv_id and g.i = best.i + 1)
        ), ends as (select conv_id, cast(substr(least(v0, v3), 1, 9) as bigint) as cost, substr(least(v0, v3), 10) as audit from best qualify row_number() over (partition by conv_id order by i desc) = 1),
        letters as (
            select conv_id, k, audit[k] as letter, count(*) filter (audit[k] <> 'I') over w as i
            from ends, range(1, length(audit) + 1) as r(k) window w as (partition by conv_id order by k)
        ), turns as (
            select l.conv_id, k, letter, g.role, g.body, l.letter = 'K' and g.c = 's' as opens,
                   count(*) filter (letter <> 'D' and not (l.letter = 'K' and g.c = 's')) over (partition by l.conv_id order by k) as nth
            from letters l left join g on g.conv_id is not distinct from l.conv_id and g.i = l.i
        ), said as (
            select conv_id, string_agg(case when letter = 'K' then role when nth % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else body end, chr(10) order by k) as body
            from turns where letter <> 'D' group by conv_id
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (twin) as duplicate,
                   count(*) filter (cut_off) as truncated, count(*) filter (illegal) as illegal
            from g group by conv_id
        )
        select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(said.body, '')) as repaired_sha256
        from (select distinct conv_id from conversations) a
        left join counts on counts.conv_id is not distinct from a.conv_id
        left join ends on ends.conv_id is not distinct from a.conv_id
        left join said on said.conv_id is not distinct from a.conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
            from documents
        ), s as (
            select doc_id, list_distinct(case
                when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
            from w
        ), t as (select doc_id, len(sh) as n, unnest(sh) as g from s),
        p as (
            select x.doc_id as a, y.doc_id as b from t x join t y on x.g = y.g and x.doc_id <> y.doc_id
            group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), r(doc_id, seen) as (
            select doc_id, doc_id from s
            union select p.b, r.seen from r join p on p.a = r.doc_id
        ), c as (select doc_id, min(seen) as component_id from r group by doc_id)
        select s.doc_id, cast(len(sh) as bigint) as n_shingles, c.component_id from s join c using (doc_id)""",
    "op4_chat_formatting": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e as (
            select *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') as e_role,
                   replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') as e_body
            from t
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
               cast(coalesce(sum(length(body)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length('<|start|>' || e_role || '<|body|>' || e_body || '<|end|>')) as bigint) as formatted_chars
        from e group by conv_id""",
    "op7_url_filters": r"""
        with u as (
            select page_id,
                   translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
            from pages
        ), k as (
            select page_id, host, path,
                   case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
                        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
                        when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
                        when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
                        when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
                   end as "rule"
            from u
        )
        select page_id, host, path, "rule",
               case when "rule" in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
        from k""",
    "op9_exact_dedup": r"""
        with n as (
            select doc_id, length(coalesce("text", '')) as size,
                   regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]', '', 'g') as t
            from documents
        )
        select doc_id,
               first_value(doc_id) over (partition by t order by size desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
               count(*) over (partition by t) as group_size,
               row_number() over (partition by t order by size desc, doc_id) = 1 as kept,
               sha256(t) as text_sha256
        from n""",
    "op11_conversation_repair": _repair_sql(),
    "op12_prefix_trie": rf"""
        with o as (
            select conv_id, coalesce(role, '') as role, coalesce("text", '') as body,
                   row_number() over (partition by conv_id order by turn nulls first, role, "text") as i
            from conversations
        ), c as (select conv_id, conv_id - conv_id % 5 as base, {_crc32("h")} % 9 as share from (select distinct conv_id, hex(encode(cast(conv_id as varchar))) as h from conversations)),
        b as (
            select c.conv_id, 0 as whose, o.i, role, body from c join o on o.conv_id = c.base and o.i <= c.share
            union all
            select c.conv_id, 1, o.i, role, body from c join o on o.conv_id = c.conv_id and o.i > c.share
        ), n as (select conv_id, row_number() over w as depth, sha256(length(role) || ':' || role || body) as turn, strlen(body) as bytes from b window w as (partition by conv_id order by whose, i)),
        p as (
            select conv_id, depth, bytes, sha256(string_agg(turn, '') over (partition by conv_id order by depth)) as node from n
            union all select conv_id, 0, 0, '' from c
        ), e as (select *, lag(node) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as final from p),
        k as (
            select node, depth, parent, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
                   sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (final), '')) as ends_sha256
            from e group by node, depth, parent
        ), t as (select k.*, (select count(*) from k x where x.parent = k.node and x.depth = k.depth + 1) as n_children from k),
        s as (
            select a.node, a.depth, count(*) filter (t.n_children = 0) as n_leaves, sum((t.n_convs - 1) * t.bytes) as saved_tokens
            from t join e a on a.conv_id = t.conv_id and a.depth <= t.depth group by a.node, a.depth
        )
        select t.conv_id, t.depth, up.conv_id as parent_conv_id, t.n_convs, t.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, t.ends_sha256
        from t join s on s.node = t.node and s.depth = t.depth left join t up on up.node = t.parent and up.depth = t.depth - 1""",
    "op13_sharding": rf"""
        with leaf as (
            select unnest([0, 1]) as grown, 'region' || (n // {SHARD_TREE[1] * SHARD_TREE[2]}) as region, 'rack' || (n // {SHARD_TREE[2]}) as rack, cast(n as varchar) as shard from range({SHARD_TREE[0] * SHARD_TREE[1] * SHARD_TREE[2]}) as r(n)
            union all select 1, 'region-of-24', 'rack-of-24', '24'
        ), children as (
            select grown, 1 as level, '' as parent, region as path, count(*) as weight from leaf group by all
            union all select grown, 2, region, region || '/' || rack, count(*) from leaf group by all
            union all select grown, 3, region || '/' || rack, region || '/' || rack || '/' || shard, count(*) from leaf group by all
        ), draws as (
            select distinct doc_id, grown, level, parent, path,
                   -ln((cast('0x' || substr(md5(path || '|' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5) / 4503599627370496.0) / weight as draw
            from documents, children
        ), picked as (select doc_id, grown, level, parent, arg_min(path, draw) as path from draws group by all),
        lies as (
            select c.doc_id, c.grown, cast(split_part(c.path, '/', 3) as int) as shard
            from picked a
            join picked b on b.doc_id is not distinct from a.doc_id and b.grown = a.grown and b.level = 2 and b.parent = a.path
            join picked c on c.doc_id is not distinct from a.doc_id and c.grown = a.grown and c.level = 3 and c.parent = b.path
            where a.level = 1
        ), d as (
            select doc_id, cast(octet_length(encode(coalesce("text", ''))) + 8 as bigint) as size, {_crc32("h")} as text_crc32
            from (select doc_id, "text", hex(encode(coalesce("text", ''))) as h from documents)
        ), n as (select *, cast('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32)), 1, 8) as bigint) % 1024 as bin from d)
        select n.doc_id, size, text_crc32, 'key' as law, x.shard,
               row_number() over (partition by x.shard order by bin, n.doc_id nulls first, size, text_crc32) - 1 as slot, y.shard as grown_shard
        from n join lies x on x.doc_id is not distinct from n.doc_id and x.grown = 0 join lies y on y.doc_id is not distinct from n.doc_id and y.grown = 1""",
}
