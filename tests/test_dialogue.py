"""Dialogue state: the batch form against a plain loop, and the stream against the batch form."""

import random
import time

import pytest

from docengine.operators import dialogue as d
from docengine.streaming import dialogue as ds

SAID = [
    "Cum se face selectivitatea intr-un tablou electric cu 3 tablouri si cupru in instalatii mari?",
    "dar cupru?",
    "aluminiu de 10 mm in interior",
    "Which word stands behind that which is written here with much more than fifty signs 16 A",
    "interior si exterior, 10 mm, 10 mm",
    "",
    None,
]


def turns(seed=3, convs=25):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "system"]), rng.choice(SAID), rng.random() < 0.4))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, asks boolean"


def plain(df):
    return sorted((r["conv_id"], r["turn"], r["kind"], r["subject"], r["action"], tuple(r["facts"]), r["combined"], r["focused"]) for r in df.collect())


def by_hand(spark, rows):
    marks = {(r["conv_id"], r["turn"]): r for r in d.marked(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = []
    for conv in sorted({r[0] for r in rows}):
        intent, facts, question, waiting, spoken = None, [], None, False, 0
        for _, turn, role, text, asks in sorted(r for r in rows if r[0] == conv):
            if role == "system":
                continue
            said, m = text or "", marks[conv, turn]
            if role == "user":
                follow = spoken > 0 and (waiting or len(said) < d.SHORT or m["leans"])
                if not follow:
                    intent, facts = (m["subject"], m["action"]), list(m["stated"])
                elif intent:
                    facts = list(dict.fromkeys(facts + m["added"]))
                combined = question + d.DETAILS + said if waiting else said
                out.append((conv, turn, "clarification" if waiting else "follow_up" if follow else "new", *(intent or (None, None)), tuple(facts), combined, " ".join([intent[1], intent[0], *facts, said]) if intent else said))
                question, waiting = said, False
            elif asks and question is not None:
                waiting = True
            spoken += 1
    return sorted(out)


def test_batch_form(spark):
    rows = turns()
    assert plain(d.dialogue(spark.createDataFrame(rows, SCHEMA).repartition(3))) == by_hand(spark, rows)
    assert d.dialogue(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # timers of processing time would let a run over what is there go on for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    for x in (name, "spark.sql.streaming.noDataMicroBatches.enabled"):
        spark.conf.unset(x)


def run(spark, source, checkpoint, sink, idle_ms=ds.IDLE_MS):
    """Once over what is there; a second run goes on from the checkpoint."""
    stream = ds.dialogue_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), idle_ms)
    q = stream.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    q.stop()


def test_stream_equals_batch_and_goes_on(rocks, tmp_path):
    spark, rows = rocks, turns(seed=9, convs=12)
    source = tmp_path / "in"
    for part in (0, 1):  # the second half of every conversation comes later, to a stream that was stopped
        spark.createDataFrame([r for r in rows if (r[1] > 3) == bool(part)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        run(spark, source, tmp_path / "state", tmp_path / "out")
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(d.dialogue(spark.createDataFrame(rows, SCHEMA)))


def test_idle_conversations_are_forgotten(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    spark.createDataFrame([(1, 0, "user", SAID[3], False)], SCHEMA).coalesce(1).write.parquet(str(source))
    run(spark, source, tmp_path / "state", tmp_path / "out", idle_ms=1)
    time.sleep(0.1)
    spark.createDataFrame([(2, 0, "user", SAID[3], False)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run(spark, source, tmp_path / "state", tmp_path / "out", idle_ms=1)
    spark.createDataFrame([(1, 1, "user", "dar cupru?", False)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run(spark, source, tmp_path / "state", tmp_path / "out", idle_ms=1)
    kinds = {(r["conv_id"], r["turn"]): r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kinds == {(1, 0): "new", (2, 0): "new", (1, 1): "new"}
