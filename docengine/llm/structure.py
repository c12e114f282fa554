"""Repair of the turns of a conversation at least cost.

A conversation is read in order by an automaton whose legal outputs are an
optional system turn and then pairs of a user's and an assistant's turn.  Every
row is kept, given another role or deleted, and empty turns may be put in
anywhere.  The states between rows and these edits are a graph without cycles
of no cost.  Least costs from its start (forward) and to its end (backward)
tell which arcs lie on a cheapest path: those with forward cost, own cost and
backward cost equal to the total.  The set of nodes that the letters chosen so
far can reach is the frontier; from it the least letter of a tight arc is
taken, so the result is the least of all cheapest edit strings.

One conversation's edits are one value, so its rows meet in one task.  There a
letter and a digest of each row are held, and its texts are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch

#: Costs of giving a row another role, deleting it, putting in an empty turn, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)

#: The state behind a turn that is put in or given the role that fits.
_FITS = (USER, USER, ASSISTANT, USER)

#: State and initial of a kept row to the state behind it.
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}

_ROLE = {USER: b"user", ASSISTANT: b"assistant"}

_FAR = 1 << 60

#: Characters of the white space of ``[\\x20\\x09-\\x0D]``.
_SPACE = " \t\n\x0b\x0c\r"

_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits of one row, by letter.

    ``symbol`` is ``d`` for a row that must go, else the role's initial (``x``:
    no legal one), a capital if the row is truncated.
    """
    arcs = [("D", DELETE, state)]
    if symbol != "d":
        more = TRUNCATED * symbol.isupper()
        if (kept := _KEEPS.get((state, symbol.lower()))) is not None:
            arcs.append(("K", more, kept))
        arcs.append(("R", REROLE + more, _FITS[state]))
    return arcs


@lru_cache(maxsize=1 << 14)
def cheapest_edits(symbols: str) -> tuple[int, str]:
    """Least cost and the ASCII-least edit string of a conversation."""
    n = len(symbols)
    forward = [[_FAR] * 4 for _ in range(n + 1)]
    forward[0][START] = 0
    for i in range(n + 1):
        f = forward[i]
        f[USER] = min(f[USER], min(f[START], f[SYSTEM], f[ASSISTANT]) + INSERT)
        f[ASSISTANT] = min(f[ASSISTANT], f[USER] + INSERT)
        if i < n:
            for state in range(4):
                for _, cost, to in _arcs(symbols[i], state):
                    forward[i + 1][to] = min(forward[i + 1][to], f[state] + cost)
    backward = [[_FAR] * 4 for _ in range(n + 1)]
    backward[n][START] = backward[n][ASSISTANT] = 0
    for i in range(n, -1, -1):
        b = backward[i]
        if i < n:
            for state in range(4):
                b[state] = min(cost + backward[i + 1][to] for _, cost, to in _arcs(symbols[i], state))
        b[USER] = min(b[USER], b[ASSISTANT] + INSERT)
        for state in (START, SYSTEM, ASSISTANT):
            b[state] = min(b[state], b[USER] + INSERT)
    total = backward[0][START]

    letters, i, frontier = [], 0, {START}
    while not (i == n and frontier & {START, ASSISTANT}):
        steps: dict[str, set[int]] = {}
        for state in frontier:
            for letter, cost, to in [("I", INSERT, _FITS[state])] + (_arcs(symbols[i], state) if i < n else []):
                if forward[i][state] + cost + backward[i + (letter != "I")][to] == total:
                    steps.setdefault(letter, set()).add(to)
        least = min(steps)
        letters.append(least)
        frontier = steps[least]
        i += least != "I"
    return total, "".join(letters)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, which depend on conversation and turn: ``conv_id, turn, role, text, present``.

    Of twenty rows one is dropped (it stays as a row that is not present), one
    loses its text, one its sentence ends, one is repeated and one is given the
    role of a user.  A null role or text is one space.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(name) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (draw != 0).alias("present"),
        F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a sorted partition."""

    def close(conv, turns, initials, faults):
        numbers = [t for t in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        illegal = sum(pair not in legal for pair in zip(initials, initials[1:]))
        symbols = "".join("d" if f in "bd" else (r if r and r in "sua" else "x").upper() if f == "t" else (r if r and r in "sua" else "x") for r, f in zip(initials, faults, strict=True))
        cost, audit = cheapest_edits(symbols)
        return conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit

    def batch_of(rows):
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    conv, turns, initials, faults, seen, begun = None, [], [], [], set(), False
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "role_text", "blank", "cut_off", "present")]
        for c, turn, initial, digest, blank, cut_off, present in zip(*columns, strict=True):
            if not begun or c != conv:
                if begun:
                    done.append(close(conv, turns, initials, faults))
                conv, turns, initials, faults, seen, begun = c, [], [], [], set(), True
            if not present:
                continue
            turns.append(turn)
            initials.append(initial)
            faults.append("b" if blank else "d" if digest in seen else "t" if cut_off else "o")
            seen.add(digest)
        if done:
            yield batch_of(done)
    if begun:
        yield batch_of([close(conv, turns, initials, faults)])


def _replay(batches: Iterator[pa.RecordBatch], begin: Callable, turn: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Run the edits of each conversation over its sorted rows, of which the summary comes first.

    ``begin(batch, i)`` is told the summary, ``turn(letter, role, text)`` every
    turn of the result, ``end()`` the end of a conversation; ``end(True)`` gives
    what has been gathered as a batch, or None.
    """
    audit, at, state, begun = "", 0, START, False

    def put_in():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _FITS[state]
            turn("I", _ROLE[state], b"")
            at += 1

    for batch in batches:
        summaries, roles, texts = batch.column("audit"), batch.column("role").cast(pa.binary()), batch.column("text").cast(pa.binary())
        heads = summaries.is_valid().to_pylist()
        present = batch.column("present").to_pylist()
        for i, head in enumerate(heads):
            if head:
                if begun:
                    put_in()
                    end(False)
                audit, at, state, begun = summaries[i].as_py(), 0, START, True
                begin(batch, i)
            elif present[i]:
                put_in()
                letter, role = audit[at], roles[i].as_py()
                at += 1
                if letter == "K":
                    state = _KEEPS[state, role[:1].decode()]
                    turn(letter, role, texts[i].as_py())
                elif letter == "R":
                    state = _FITS[state]
                    turn(letter, _ROLE[state], texts[i].as_py())
        if (out := end(True)) is not None:
            yield out
    if begun:
        put_in()
        end(False)
        if (out := end(True)) is not None:
            yield out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads, shas, now = [], [], [None, True]

    def begin(batch, i):
        heads.append(batch.select(names).slice(i, 1))
        now[:] = [hashlib.sha256(), True]

    def turn(letter, role, text):
        if not now[1]:
            now[0].update(b"\n")
        now[1] = False
        now[0].update(role + b":")
        now[0].update(text)

    def end(flush):
        if not flush:
            shas.append(now[0].hexdigest())
            return None
        if not shas:
            return None
        n = len(shas)
        whole = pa.Table.from_batches(heads[:n]).combine_chunks()
        out = pa.RecordBatch.from_arrays([*[c.chunk(0) for c in whole.columns], pa.array(shas)], names=[*names, "repaired_sha256"])
        del heads[:n], shas[:]
        return out

    return _replay(batches, begin, turn, end)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now = [], [None, 0]

    def begin(batch, i):
        now[:] = [batch.column("conv_id")[i].as_py(), 0]

    def turn(letter, role, text):
        rows.append((now[0], now[1], letter, role.decode(), text.decode()))
        now[1] += 1

    def end(flush):
        if not flush or not rows:
            return None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "edit", "role", "text"])
        rows.clear()
        return out

    return _replay(batches, begin, turn, end)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one partition and in turn; rows of one turn go by role and digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "role_text")


def _prepared(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with what is known of each, and one summary per conversation, written to the shared folder."""
    present = F.coalesce("present", F.lit(True)) if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("role_text", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", "role_text", "present", F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"))
    summary = Scratch(turns.sparkSession, "structure").save(_in_order(narrow).mapInArrow(_summaries, f"conv_id long, {_SUMMARY}"), "summaries")
    return rows, summary


def _with_edits(turns: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its summary in front of them."""
    rows, summary = _prepared(turns)
    both = rows.withColumn("head", F.lit(1)).unionByName(summary.withColumn("head", F.lit(0)), allowMissingColumns=True)
    return _in_order(both, "head")


def audit_structure(turns: DataFrame) -> DataFrame:
    """Faults, least cost, edits and digest of the repaired text of every conversation.

    ``turns`` has ``conv_id, turn, role, text`` and, if wanted, ``present``: a
    row that is not present only names its conversation.  Rows go by turn, null
    turns first, then by role and digest.  The first fault of a row counts:
    blank (no character but white space), duplicate (role and text seen
    earlier), truncated (the last such character is none of ``.!?``).

    One row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.  A null role or text is one space;
    rows without a conversation's id are one conversation; repeated rows are
    duplicates.  A conversation of which no row is present has zeros, an empty
    audit and the digest of the empty text.  Other columns are not read.  An
    empty table gives an empty result.
    """
    return _with_edits(turns).mapInArrow(_digests, f"conv_id long, {_SUMMARY}, repaired_sha256 string")


def repair_structure(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, turn`` (from 0), ``edit`` (K, R or I), ``role, text``; cases as in :func:`audit_structure`."""
    return _with_edits(turns).mapInArrow(_turns, "conv_id long, turn long, edit string, role string, text string")
