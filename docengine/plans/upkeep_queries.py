"""Queries of tables that are kept up, of batches that are resumed and of events that are folded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import lifecycle
from docengine.plans.registry import query
from docengine.sources import shared
from docengine.sources.tables import PARAGRAPHS_SQL, paragraphs, table
from docengine.sources.upkeep import KeptTable
from docengine.streaming.batches import Batches


def _kept(spark: SparkSession, sf: str) -> tuple[KeptTable, KeptTable]:
    """Documents, and their paragraphs as their children, as tables that are kept up."""
    path = shared.new_path(spark, "kept")
    children = KeptTable(spark, f"{path}/paragraphs", "doc_id", "doc_id long, paragraph_number long, content string", 16)
    parents = KeptTable(spark, f"{path}/documents", "doc_id", "doc_id long, n_chars long, version long", 16, (children,))
    docs = table(spark, sf, "documents")
    parents.create(docs.select("doc_id", "n_chars", F.lit(0).cast("long").alias("version")))
    children.create(paragraphs(docs))
    return parents, children


@query(
    "kept_upsert",
    "select doc_id, n_chars, version from (select *, row_number() over (partition by doc_id order by version desc) as n from (select doc_id, n_chars, 0 as version from documents union all select doc_id, quality * 1000, 1 from labels union all select doc_id + 1000000, 7, 2 from labels where toxic = 1)) where n = 1",
)
def kept_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New and changed rows go into the stored table's buckets."""
    parents, _ = _kept(spark, sf)
    labels = table(spark, sf, "labels")
    changes = labels.select("doc_id", (F.col("quality") * 1000).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("version"))
    fresh = labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit(7).cast("long").alias("n_chars"), F.lit(2).cast("long").alias("version"))
    parents.upsert(changes.unionByName(fresh), F.desc("version"))
    return parents.read()


@query(
    "kept_delete",
    f"with {PARAGRAPHS_SQL}, gone as (select doc_id from labels where quality = 0) select d.doc_id, d.n_chars, count(p.doc_id) as n_paragraphs from documents d left join p using (doc_id) where doc_id not in (select doc_id from gone) group by d.doc_id, d.n_chars union all select -1, count(*), count(distinct doc_id) from p where doc_id not in (select doc_id from gone)",
)
def kept_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted documents take their paragraphs along; the last row counts the paragraphs that are left."""
    parents, children = _kept(spark, sf)
    parents.delete(table(spark, sf, "labels").where("quality = 0").select("doc_id"))
    left = children.read()
    counts = left.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))
    out = parents.read().join(counts, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
    total = left.agg(F.lit(-1).cast("long").alias("doc_id"), F.count("*").alias("n_chars"), F.count_distinct("doc_id").alias("n_paragraphs"))
    return out.unionByName(total)


@query(
    "kept_clear",
    f"with {PARAGRAPHS_SQL} select 'documents' as name, count(*) as cleared, 0 as remaining from documents union all select 'paragraphs', count(*), 0 from p",
)
def kept_clear(spark: SparkSession, sf: str) -> DataFrame:
    """An index that is cleared: what was there, and what is left."""
    parents, children = _kept(spark, sf)
    counts = parents.clear()
    rows = [(t.path.rsplit("/", 1)[1], counts[t.path], t.read().count()) for t in (parents, children)]
    return spark.createDataFrame(rows, "name string, cleared long, remaining long")


def _lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of users as those of documents: by event and user, mostly in a legal order."""
    n = F.pmod(F.col("event_id") + F.col("user_id"), F.lit(8))
    name = F.when(n < 2, "start").when(n < 5, "add").when(n < 7, "complete").otherwise("fail")
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("place"), name.alias("name"))


_FOLD_SQL = """with recursive e as (
        select user_id as key, event_id as place, case when (event_id + user_id) % 8 < 2 then 'start' when (event_id + user_id) % 8 < 5 then 'add' when (event_id + user_id) % 8 < 7 then 'complete' else 'fail' end as name,
               row_number() over (partition by user_id order by event_id) as i from events
    ), f(key, i, state, illegal, last_place) as (
        select distinct key, 0, 'PENDING', 0, cast(-1 as bigint) from e
        union all
        select f.key, e.i, case when name = 'fail' then 'FAILED' when name = 'start' and state = 'PENDING' then 'PROCESSING' when name = 'complete' and state = 'PROCESSING' then 'COMPLETED' else state end,
               illegal + case when name = 'fail' or (name = 'start' and state = 'PENDING') or (name in ('add', 'complete') and state = 'PROCESSING') then 0 else 1 end, e.place
        from f join e on e.key = f.key and e.i = f.i + 1
    ) select key, state, cast(i as bigint) as n_events, cast(illegal as bigint) as illegal, last_place from f qualify row_number() over (partition by key order by i desc) = 1"""


@query("event_fold", _FOLD_SQL)
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    """States of all keys: a snapshot over the events before the middle, then the later ones."""
    events = _lifecycle_events(spark, sf)
    middle = events.agg(F.floor(F.avg("place"))).first()[0]
    snapshot = shared.saved(lifecycle.fold(events.where(F.col("place") <= middle)), "snapshot")
    return lifecycle.fold(events, snapshot)


@query(
    "batch_manifest",
    """with a as (select doc_id, n_chars, cast(case when n_chars % 21 = 0 then 3 when n_chars % 7 = 0 then 2 else 1 end as int) as attempts, n_chars % 21 <> 0 as ok from documents)
    select doc_id, attempts, ok, case when ok then n_chars * 2 end as result from a""",
)
def batch_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents worked on in resumable batches; some fail once, some always."""
    path = shared.new_path(spark, "batches")
    table(spark, sf, "documents").select("doc_id", "n_chars").repartition(4).write.parquet(f"{path}/landing")

    def work(rows: DataFrame) -> DataFrame:
        ok = (F.col("n_chars") % 7 != 0) | ((F.col("n_chars") % 21 != 0) & (F.col("attempt") > 1))
        return rows.select("doc_id", ok.alias("ok"), (F.col("n_chars") * 2).alias("result"))

    runs = Batches(spark, f"{path}/landing", f"{path}/home", "doc_id long, n_chars long", "doc_id", work, files=4)
    runs.run_all()
    each = runs.manifest().groupBy("doc_id").agg(F.max("attempt").alias("attempts"), F.bool_or("ok").alias("ok"))
    return each.join(runs.results(), "doc_id", "left")
