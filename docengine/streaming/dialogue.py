"""Dialogue state kept by a stream: subject and action, facts, and the question that waits for a clarification.

State is keyed by conversation and holds values, a list and a timer; a
conversation in which nothing is said for a while is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from docengine.operators.dialogue import DETAILS, marked

#: Milliseconds without a message after which a conversation is forgotten. Fixed value.
IDLE_MS = 30 * 60 * 1000

OUT = "conv_id long, turn long, kind string, subject string, action string, facts array<string>, combined string, focused string"


class DialogueState(StatefulProcessor):
    """The rules of :func:`docengine.operators.dialogue.dialogue`, message by message."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.intent = handle.getValueState("intent", "subject string, action string")
        self.facts = handle.getListState("facts", "fact string")
        self.pending = handle.getValueState("pending", "question string, waiting boolean")
        self.spoken = handle.getValueState("spoken", "messages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        intent = self.intent.get() if self.intent.exists() else None
        facts = [f[0] for f in self.facts.get()] if self.facts.exists() else []
        question, waiting = self.pending.get() if self.pending.exists() else (None, False)
        spoken = self.spoken.get()[0] if self.spoken.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            if not r.user:
                waiting = waiting or (bool(r.asks) and question is not None)
            else:
                new = not (spoken and (waiting or r.leans))
                if new:
                    intent, facts = (r.subject, r.action), []
                if intent is not None:
                    facts += [f for f in dict.fromkeys(r.stated if new else r.added) if f not in facts]
                kind = "clarification" if waiting else "new" if new else "follow_up"
                combined = question + DETAILS + r.said if waiting else r.said
                about, wanted = intent or (None, None)
                focused = " ".join([wanted, about, *facts, r.said]) if intent else r.said
                out.append((key[0], r.turn, kind, about, wanted, list(facts), combined, focused))
                question, waiting = r.said, False
            spoken += 1
        if intent is not None:
            self.intent.update(tuple(intent))
            self.facts.put([(f,) for f in facts])
        self.pending.update((question, waiting))
        self.spoken.update((spoken,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.intent, self.facts, self.pending, self.spoken):
            state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def dialogue_stream(turns: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The users' messages of a stream of turns with the state at each; late messages go on from the state that is there.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    A run over what is there (``availableNow``) ends only without batches of no
    data (``spark.sql.streaming.noDataMicroBatches.enabled``), as timers may be due at any time.
    """
    return marked(turns).groupBy("conv_id").transformWithStateInPandas(statefulProcessor=DialogueState(idle_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime")
