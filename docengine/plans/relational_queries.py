"""Queries of the relational and operational analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.text import contains_any, js_round
from docengine.operators import ops
from docengine.operators.understanding import FOLLOW_UP
from docengine.plans.registry import query
from docengine.sources.tables import first_row, table


# ---- filters, joins and sets


@query("access_filter", "select c_custkey from customer c where c_nationkey = 3 or c_mktsegment = 'BUILDING' or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority in ('1-URGENT', '2-HIGH'))")
def access_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Owner, public or member: the membership test is a semi join."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    members = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_custkey").distinct()
    joined = customers.join(members.withColumn("is_member", F.lit(True)), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where((F.col("c_nationkey") == 3) | (F.col("c_mktsegment") == "BUILDING") | F.col("is_member").isNotNull()).select("c_custkey")


@query("write_access", "select distinct c_custkey from customer join orders on o_custkey = c_custkey and o_orderstatus in ('F', 'O') where c_acctbal > 0")
def write_access(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return table(spark, sf, "customer").where("c_acctbal > 0").join(roles, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("dynamic_filter", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice between 1000 and 200000 and contains(lower(o_orderpriority), 'high')")
def dynamic_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"status": "F", "least": 1000, "most": 200000, "name": "HIGH"}
    rows = table(spark, sf, "orders").where((F.col("o_orderstatus") == wanted["status"]) & F.col("o_totalprice").between(wanted["least"], wanted["most"]))
    return rows.where(F.contains(F.lower("o_orderpriority"), F.lit(wanted["name"].lower()))).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("array_overlap", """select doc_id from documents where list_has_any(string_split(lower("text"), ' '), ['that', 'nicht', 'pour'])""")
def array_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.arrays_overlap(F.split(F.lower("text"), " "), F.array(F.lit("that"), F.lit("nicht"), F.lit("pour")))).select("doc_id")


@query("missing_ids", "select item_id from benchmark where item_id not in (select doc_id from labels)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").join(table(spark, sf, "labels"), F.col("item_id") == F.col("doc_id"), "left_anti").select("item_id")


@query("left_anti_new", "select doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def left_anti_new(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("cascade_delete", "with gone as (select c_custkey from customer where c_acctbal < 0), o as (select * from orders where o_custkey not in (select c_custkey from gone)) select count(*) as n_lines, round(sum(l_quantity), 2) as quantity from lineitem where l_orderkey in (select o_orderkey from o)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").join(gone, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(orders, "l_orderkey", "left_semi").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("nested_children", "select o_custkey, count(*) as n, string_agg(cast(o_orderkey as varchar), ',' order by o_orderdate desc, o_orderkey) as orders from orders group by o_custkey")
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), "o_orderkey").alias("x"))
    grouped = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("all"), F.count("*").alias("n"))
    return grouped.select("o_custkey", "n", F.array_join(F.transform("all", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("child_counts", "select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by c_custkey")
def child_counts(spark: SparkSession, sf: str) -> DataFrame:
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("upsert", "select doc_id, n_chars, version from (select *, row_number() over (partition by doc_id order by version desc) as n from (select doc_id, n_chars, 0 as version from documents union all select doc_id, quality * 1000, 1 from labels)) where n = 1")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Insert or replace by key: the newest version of each key stays."""
    old = table(spark, sf, "documents").select("doc_id", "n_chars", F.lit(0).alias("version"))
    new = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 1000).cast("long").alias("n_chars"), F.lit(1).alias("version"))
    return first_row(old.unionByName(new), ["doc_id"], F.desc("version"))


@query("distinct_in_order", """select doc_id, array_to_string(list_distinct_ordered, ' ') as firsts from (select doc_id, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:5] as list_distinct_ordered from (select doc_id, string_split(lower("text"), ' ') as ws from documents))""")
def distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.split(F.lower("text"), " ")), 1, 5), " ").alias("firsts"))


# ---- aggregates


@query("feedback_stats", "select count(*) as total, count(*) filter (quality = 1) as positive, count(*) filter (quality = 0) as negative, cast(floor(count(*) filter (quality = 1) / count(*) * 100 + 0.5) as bigint) as satisfaction, round(avg(toxic), 6) as mean_toxic from labels")
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    good = F.count_if(F.col("quality") == 1)
    rate = F.when(F.count("*") == 0, 0).otherwise(js_round(good / F.count("*") * 100))
    return table(spark, sf, "labels").agg(F.count("*").alias("total"), good.alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"), rate.alias("satisfaction"), F.round(F.avg("toxic"), 6).alias("mean_toxic"))


@query("status_counts", "select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("dashboard", "select 'customers' as metric, count(*) as n from customer union all select 'recent_events', count(*) from events where ts >= timestamp '2024-01-23' union all select 'orders_' || o_orderstatus, count(*) from orders group by o_orderstatus union all select 'feedback_' || quality, count(*) from labels group by quality")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    recent = table(spark, sf, "events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-23 00:00:00")))
    parts = [
        table(spark, sf, "customer").agg(F.lit("customers").alias("metric"), F.count("*").alias("n")),
        recent.agg(F.lit("recent_events").alias("metric"), F.count("*").alias("n")),
        table(spark, sf, "orders").groupBy(F.concat(F.lit("orders_"), "o_orderstatus").alias("metric")).agg(F.count("*").alias("n")),
        table(spark, sf, "labels").groupBy(F.concat(F.lit("feedback_"), F.col("quality").cast("string")).alias("metric")).agg(F.count("*").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("top_prefix", "select prefix, n, cast(floor(n / total * 100 + 0.5) as bigint) as percent from (select split_part(o_orderpriority, '-', 1) as prefix, count(*) as n, (select count(*) from orders) as total from orders group by 1) order by n desc, prefix limit 5")
def top_prefix(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the groups, a handful of rows
    return counts.select("prefix", "n", js_round(F.col("n") / total * 100).alias("percent")).orderBy(F.desc("n"), "prefix").limit(5)


@query("doc_stats", "select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars, round(avg(n_chars), 6) as mean_chars, count(*) filter (n_chars > 1000) as long_docs, count(l.doc_id) as labelled from documents d left join labels l using (doc_id) group by lang")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") > 1000).alias("long_docs"), F.count("quality").alias("labelled"))


@query("index_progress", "select count(*) filter (done) as indexed, count(*) filter (not done) as pending, cast(count(*) filter (not done) * 2 as bigint) as eta_minutes from (select d.doc_id, l.doc_id is not null as done from documents d left join labels l using (doc_id))")
def index_progress(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    pending = F.count_if(F.col("done").isNull())
    return joined.agg(F.count("done").alias("indexed"), pending.alias("pending"), (pending * 2).alias("eta_minutes"))


@query("source_names", "select lang, string_agg(distinct source, ',' order by source) as sources from documents group by lang")
def source_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


# ---- windows, order, limits


@query("paginate", "select o_orderkey, o_totalprice, (select count(*) from orders) as total, cast(ceil((select count(*) from orders) / 20) as bigint) as pages from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    total = orders.agg(F.count("*").alias("total"))
    page = orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 20))


@query("recent_window", "select event_type, count(*) as n, round(sum(value), 4) as total from events where ts >= timestamp '2024-01-23' group by event_type")
def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    recent = table(spark, sf, "events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-23 00:00:00")))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("latest_n", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 50")
def latest_n(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 50").select("user_id", "event_id")


@query("best_and_margin", "select l_orderkey, l_linenumber as best_line, round(l_extendedprice - coalesce(next_price, 0), 2) as margin from (select *, lead(l_extendedprice) over w as next_price, row_number() over w as n from lineitem window w as (partition by l_orderkey order by l_extendedprice desc, l_linenumber)) where n = 1")
def best_and_margin(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.lead("l_extendedprice").over(w).alias("next_price"), F.row_number().over(w).alias("n"))
    return rows.where("n = 1").select("l_orderkey", F.col("l_linenumber").alias("best_line"), F.round(F.col("l_extendedprice") - F.coalesce("next_price", F.lit(0.0)), 2).alias("margin"))


@query("seeded_sample", "select o_orderkey from orders order by md5(o_orderkey || '-7'), o_orderkey limit 100")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A reproducible sample of 100 rows."""
    return table(spark, sf, "orders").select("o_orderkey").orderBy(F.md5(F.concat("o_orderkey", F.lit("-7"))), "o_orderkey").limit(100)


# ---- operational state


@query("rate_limit_count", "select event_id, user_id, count(*) over (partition by user_id order by epoch_s range between 3599 preceding and current row) as in_window from (select *, cast(floor(epoch(ts)) as bigint) as epoch_s from events)")
def rate_limit_count(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select("event_id", "user_id", ops.window_count(events, "user_id", "ts", 3600).alias("in_window"))


@query(
    "rate_limit_admit",
    """with recursive e as (select user_id, event_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
    r as (select user_id, event_id, n, true as allowed, [t] as held from e where n = 1
        union all select user_id, event_id, n, len(recent) < 2, case when len(recent) < 2 then list_append(recent, t) else recent end
        from (select e.*, list_filter(r.held, lambda x: x > e.t - 3600) as recent from r join e on e.user_id = r.user_id and e.n = r.n + 1))
    select user_id, event_id, allowed, 2 - len(held) as remaining, held[1] + 3600 as reset_at from r""",
)
def rate_limit_admit(spark: SparkSession, sf: str) -> DataFrame:
    return ops.admit(table(spark, sf, "events"), most=2, seconds=3600)


@query("cache_ttl_refresh", "select event_id, coalesce(t - lag(t) over (partition by user_id, event_type order by t, event_id) < 86400, false) as hit from (select *, cast(floor(epoch(ts)) as bigint) as t from events)")
def cache_ttl_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cache_hits(table(spark, sf, "events"), F.concat_ws(":", "user_id", "event_type"), "ts", refresh=True).select("event_id", "hit")


@query(
    "cache_ttl_hits",
    """with recursive e as (select *, row_number() over (partition by user_id, event_type order by t, event_id) as n from (select *, cast(floor(epoch(ts)) as bigint) as t from events)),
    r as (select user_id, event_type, event_id, n, t as since, false as hit from e where n = 1
        union all select e.user_id, e.event_type, e.event_id, e.n, case when e.t - since < 86400 then since else e.t end, e.t - since < 86400 from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.n = r.n + 1)
    select event_id, hit from r""",
)
def cache_ttl_hits(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cache_hits(table(spark, sf, "events"), F.concat_ws(":", "user_id", "event_type"), "ts").select("event_id", "hit")


@query("cache_hit_rate", "select event_type, cast(floor(avg(case when hit then 100.0 else 0 end) + 0.5) as bigint) as hit_rate from (select event_type, coalesce(t - lag(t) over (partition by user_id, event_type order by t, event_id) < 86400, false) as hit from (select *, cast(floor(epoch(ts)) as bigint) as t from events)) group by event_type")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    hits = ops.cache_hits(table(spark, sf, "events"), F.concat_ws(":", "user_id", "event_type"), "ts", refresh=True)
    return hits.groupBy("event_type").agg(js_round(F.avg(F.when(F.col("hit"), 100.0).otherwise(0.0))).alias("hit_rate"))


@query("cache_keys", r"""select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce("text", '')), '\s+', ' ', 'g'), '^ | $', '', 'g'), '[?.,!]', '', 'g'), '') as cache_key from conversations where role = 'user'""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "), "^ | $", ""), "[?.,!]", "")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", key.alias("cache_key"))


@query("popular_queries", "select user_id, event_type, count(*) as n from events group by all order by n desc, user_id, event_type limit 10")
def popular_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id", "event_type").limit(10)


@query("cache_eviction", "select user_id from (select user_id, count(*) as hits, min(event_id) as first_id from events group by user_id) order by hits, first_id limit (select case when count(distinct user_id) >= 100 then 100 else 0 end from events)")
def cache_eviction(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("hits"), F.min("event_id").alias("first_id"))
    return ops.evicted(entries, "hits", "first_id", size=100).select("user_id")


@query("token_ledger", "select event_id, user_id, cost, cast(sum(cost) over (partition by user_id order by ts, event_id) as bigint) as used from (select *, case event_type when 'view' then 1 when 'signup' then 5 when 'click' then 2 when 'error' then 3 else 0 end as cost from events)")
def token_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("cost", ops.cost_of(F.col("event_type")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", "user_id", "cost", F.sum("cost").over(w).alias("used"))


@query(
    "token_spend",
    """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) as n from (select *, case event_type when 'view' then 1 when 'signup' then 5 when 'click' then 2 when 'error' then 3 else 0 end as cost from events)),
    r as (select user_id, event_id, n, cost <= 20 as accepted, case when cost <= 20 then 20 - cost else 20 end as balance from e where n = 1
        union all select e.user_id, e.event_id, e.n, e.cost <= balance, case when e.cost <= balance then balance - e.cost else balance end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select user_id, event_id, accepted, balance from r""",
)
def token_spend(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), ops.cost_of(F.col("event_type")).alias("cost"))
    return ops.spend(rows, opening=20)


@query("token_balance", "select user_id, cast(sum(case when event_type = 'purchase' then cast(floor(value) as bigint) else 0 end) as bigint) as bought, cast(sum(case event_type when 'view' then 1 when 'signup' then 5 when 'click' then 2 when 'error' then 3 else 0 end) as bigint) as used from events group by user_id")
def token_balance(spark: SparkSession, sf: str) -> DataFrame:
    bought = F.sum(F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(bought.alias("bought"), F.sum(ops.cost_of(F.col("event_type"))).alias("used"))


@query("daily_refill", "select user_id, cast(ts as date)::varchar as day, min(event_id) as first_event from events group by all")
def daily_refill(spark: SparkSession, sf: str) -> DataFrame:
    """At most one refill per user and day: the day's first event triggers it."""
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.min("event_id").alias("first_event"))


@query("plan_lookup", "select c_custkey, plan, tokens from customer join (values (0, 'starter', 1000), (1, 'pro', 5000), (2, 'enterprise', 20000)) p(k, plan, tokens) on c_custkey % 3 = k")
def plan_lookup(spark: SparkSession, sf: str) -> DataFrame:
    plans = spark.createDataFrame([(i, name, tokens) for i, (name, _, tokens) in enumerate(ops.PLANS)], "k long, plan string, tokens long")
    return table(spark, sf, "customer").join(F.broadcast(plans), F.col("c_custkey") % 3 == F.col("k")).select("c_custkey", "plan", "tokens")


@query("priority_queue", "select o_orderkey, row_number() over (order by epoch_ms(o_orderdate) - case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1000000 when o_orderpriority = '5-LOW' then -1000000 else 0 end, o_orderkey) as place from orders order by place limit 100")
def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The next 100 jobs: time, moved forward or back by priority."""
    moved = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1_000_000).when(F.col("o_orderpriority") == "5-LOW", -1_000_000).otherwise(0)
    scored = table(spark, sf, "orders").select("o_orderkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) - moved).alias("score"))
    top = scored.orderBy("score", "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("score", "o_orderkey")).cast("long").alias("place"))


@query("state_transitions", "select before, after, count(*) as n from (select lag(event_type) over (partition by user_id order by ts, event_id) as before, event_type as after from events) where before is not null group by all")
def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select(before.alias("before"), F.col("event_type").alias("after")).where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


# ---- chat state


@query("chat_history", """select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 10""")
def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 10").select("conv_id", "turn", "role")


@query("followup", f"""select conv_id, turn, turn > 0 and (length(coalesce("text", '')) < 50 or {" or ".join(f"contains(lower(coalesce(\"text\", '')), '{w}')" for w in FOLLOW_UP)}) as is_followup from conversations where role = 'user'""")
def followup(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that lean on what was said: short ones, and those with a word of reference."""
    said = F.coalesce("text", F.lit(""))
    users = table(spark, sf, "conversations").where("role = 'user'")
    short = (F.char_length(said) < 50) | contains_any(said, FOLLOW_UP)
    return users.select("conv_id", "turn", ((F.col("turn") > 0) & short).alias("is_followup"))


@query("session_timeout", "with g as (select user_id, ts, event_id, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) < 1800 then 0 else 1 end as starts from events), s as (select *, sum(starts) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_no from g) select user_id, cast(session_no as bigint) as session_no, count(*) as n from s group by all")
def session_timeout(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions end after 30 minutes without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    starts = F.when(t - F.lag(t).over(w) < 1_800_000_000, 0).otherwise(1)
    rows = table(spark, sf, "events").withColumn("starts", starts)
    rows = rows.withColumn("session_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


# ---- evaluation


@query("eval_accuracy", "select count(*) as total, count(*) filter (ok) as correct, count(*) filter (quality is null) as no_answer, round(avg(case when ok then 1.0 else 0 end) * 100, 6) as accuracy from (select quality, coalesce(quality = case when n_chars > 300 then 1 else 0 end, false) as ok from documents left join labels using (doc_id))")
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.withColumn("ok", F.coalesce(F.col("quality") == F.when(F.col("n_chars") > 300, 1).otherwise(0), F.lit(False)))
    return rows.agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"), F.count_if(F.col("quality").isNull()).alias("no_answer"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)) * 100, 6).alias("accuracy"))


@query("eval_by_category", "select source as category, round(avg(quality), 6) as mean_score, count(*) filter (quality = 1) as passed, round(avg(n_chars), 6) as mean_chars from documents join labels using (doc_id) group by source")
def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy(F.col("source").alias("category")).agg(F.round(F.avg("quality"), 6).alias("mean_score"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


_SCORE = "least(10, greatest(0, 5 - case when quality = 0 then 3 else 0 end - case when toxic = 1 then 2 else 0 end - case when n_chars < 50 then 1 else 0 end + case when quality = 1 and toxic = 0 then 2 else 0 end))"


@query("score_buckets", f"select case when s >= 8 then '8-10' when s >= 6 then '6-7' when s >= 4 then '4-5' else '0-3' end as bucket, count(*) as n from (select {_SCORE} as s from documents join labels using (doc_id)) group by 1")
def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The rule score, clamped to 0..10, in four buckets."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    one = lambda c, k: F.when(c, k).otherwise(0)
    score = 5 - one(F.col("quality") == 0, 3) - one(F.col("toxic") == 1, 2) - one(F.col("n_chars") < 50, 1) + one((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    score = F.least(F.lit(10), F.greatest(F.lit(0), score))
    bucket = F.when(score >= 8, "8-10").when(score >= 6, "6-7").when(score >= 4, "4-5").otherwise("0-3")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("issue_freq", "select issue, count(*) as n from (select unnest(list_filter([case when quality = 0 then 'low quality' end, case when toxic = 1 then 'toxic' end, case when n_chars < 200 then 'short' end], lambda x: x is not null)) as issue from documents join labels using (doc_id)) group by issue order by n desc, issue limit 8")
def issue_freq(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    issues = F.array_compact(F.array(F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short")))
    return rows.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(8)


@query("error_letters", "select letter, count(q.doc_id) as n from (values ('a'), ('b'), ('c'), ('z')) l(letter) left join (select doc_id, substr('abc', cast(doc_id % 3 + 1 as int), 1) as expected from labels where quality = 0) q on expected = letter group by letter")
def error_letters(spark: SparkSession, sf: str) -> DataFrame:
    letters = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "letter string")
    wrong = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.substring(F.lit("abc"), (F.col("doc_id") % 3 + 1).cast("int"), 1).alias("expected"))
    return letters.join(wrong, F.col("expected") == F.col("letter"), "left").groupBy("letter").agg(F.count("doc_id").alias("n"))
