"""Kept tables, resumable batches and folded events."""

import random
from pathlib import Path

import pytest

from docengine.operators import lifecycle
from docengine.sources.upkeep import KeptTable
from docengine.streaming.batches import Batches


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    kept = KeptTable(spark, f"{tmp_path}/t", "id", "id long, said string", buckets=8)
    kept.create(spark.range(200).selectExpr("id", "'old' as said"))
    before = files(tmp_path / "t")
    kept.upsert(spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (900, "more", 1), (None, "no key", 1)], "id long, said string, v int").select("id", "said", "v").drop("v"))
    after = files(tmp_path / "t")
    touched = {f.split("/")[0] for f in before ^ after}
    assert 1 <= len(touched) <= 2 and len(before & after) >= 6
    got = dict(kept.read().collect())
    assert len(got) == 201 and got[5] in ("new", "newer") and got[900] == "more" and got[6] == "old"
    kept.upsert(spark.createDataFrame([], "id long, said string"))
    assert files(tmp_path / "t") == after


def test_deletes_take_children_along_and_empty_buckets_go(spark, tmp_path):
    children = KeptTable(spark, f"{tmp_path}/c", "id", "id long, part long", buckets=4)
    kept = KeptTable(spark, f"{tmp_path}/t", "id", "id long, said string", buckets=64, children=(children,))
    kept.create(spark.range(40).selectExpr("id", "'x' as said"))
    children.create(spark.range(40).selectExpr("id", "explode(sequence(0L, id % 3)) as part"))
    kept.delete(spark.range(0, 40, 2))
    assert {r[0] for r in kept.read().collect()} == {r[0] for r in children.read().collect()} == set(range(1, 40, 2))
    kept.delete(spark.range(100, 110))
    assert kept.read().count() == 20
    counts = kept.clear()
    assert counts[f"{tmp_path}/t"] == 20 and kept.read().count() == 0 == children.read().count()
    kept.upsert(spark.createDataFrame([(1, "again")], "id long, said string"))
    assert kept.read().count() == 1


def test_a_table_needs_keys(spark, tmp_path):
    with pytest.raises(Exception, match="needs a key"):
        KeptTable(spark, f"{tmp_path}/t", "id", "id long, said string").create(spark.createDataFrame([(None, "x")], "id long, said string"))


@pytest.mark.parametrize("stop", ["work", "results", "requeue", "manifest"])
def test_batches_go_on_where_they_were_stopped(spark, tmp_path, monkeypatch, stop):
    landing, home = f"{tmp_path}/in", f"{tmp_path}/home"
    for part in range(3):
        spark.range(part * 10, part * 10 + 12).coalesce(1).write.mode("append").parquet(landing)  # two ids of each file are in the next one too
    seen = []

    def work(rows):
        seen.append(sorted((r["id"], r["attempt"]) for r in rows.collect()))
        return rows.selectExpr("id", "id % 10 <> 3 or (id = 13 and attempt = 2) as ok", "id * id as square")

    runs = Batches(spark, landing, home, "id long", "id", work)
    plain, calls = Batches._once, []

    def once(self, rows, path, again=False):
        calls.append(path)
        if stop != "work" and len([c for c in calls if stop in c]) == 1 and stop in path and len(seen) <= 2:
            calls.append(stop)
            raise RuntimeError("stopped")
        return plain(self, rows, path, again)

    monkeypatch.setattr(Batches, "_once", once)
    if stop == "work":
        runs.work = lambda rows: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(Exception, match="stopped"):
        runs.run()
    again = Batches(spark, landing, home, "id long", "id", work)
    again.run_all()
    assert sorted(map(tuple, again.results().collect())) == [(i, i * i) for i in range(32) if i % 10 != 3 or i == 13]
    manifest = sorted((r["id"], r["attempt"], r["ok"]) for r in again.manifest().collect())
    want = [(i, 1, i % 10 != 3) for i in range(32)] + [(3, 2, False), (3, 3, False), (13, 2, True), (23, 2, False), (23, 3, False)]
    assert manifest == sorted(want)
    assert again.progress() == {"done": 30, "failed": 2, "waiting": 0}
    n = len(seen)
    again.run_all()
    assert len(seen) == n  # nothing is left to do


def by_hand(events):
    out = {}
    for key, place, name in sorted(events):
        state, n, bad, _ = out.get(key, (0, 0, 0, None))
        to = lifecycle.LEADS.get(name, (-1,) * 4)[state]
        out[key] = (state if to < 0 else to, n + 1, bad + (to < 0), place)
    return {k: (lifecycle.STATES[s], n, bad, last) for k, (s, n, bad, last) in out.items()}


def test_fold_from_every_cut(spark):
    rng = random.Random(4)
    events = [(k, p, rng.choice(["start", "add", "complete", "fail", "start", "add", "other", None])) for k in range(6) for p in rng.sample(range(100), rng.randrange(0, 30))]
    df = spark.createDataFrame(events, "key long, place long, name string").repartition(3)
    want = by_hand(events)
    plain = lambda rows: {r["key"]: (r["state"], r["n_events"], r["illegal"], r["last_place"]) for r in rows.collect()}
    for piece in (1, 4, 512):
        assert plain(lifecycle.fold(df, piece=piece)) == want
    for cut in (-1, 10, 50, 99):
        snapshot = spark.createDataFrame(lifecycle.fold(df.where(f"place <= {cut}"), piece=5).collect(), "key long, state string, n_events long, illegal long, last_place long")
        assert plain(lifecycle.fold(df, snapshot, piece=5)) == want
        older = spark.createDataFrame(lifecycle.fold(df.where(f"place <= {cut - 9}")).collect(), snapshot.schema)
        assert plain(lifecycle.fold(df, snapshot.unionByName(older))) == want  # the last snapshot counts
    assert lifecycle.fold(df.limit(0)).count() == 0
