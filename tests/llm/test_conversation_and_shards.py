"""Structure repair, prefix trie and hash-tree sharding against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docengine.llm import prefix_trie as trie
from docengine.llm.common import Scratch
from docengine.llm.prefix_trie import prefix_trie, share_heads, subtree_sums, turn_rows
from docengine.llm.shard_tree import Shard, even_tree, place, with_shard
from docengine.llm.structure import audit_structure, cheapest_edits, damage, repair_structure

SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, base string, depth string, node string, copy int, h int, present_ int"
CLASH = ("b", "d", "n", 1, 2, 3)


def conversations():
    rng = random.Random(5)
    said = ["Ask. ", "Tell me", "No!", "é" * 40 + "?", "", " \t", None, "x " * 4000 + "."]
    out = []
    for conv in [*range(0, 34), 1000, 1001, None]:
        opening = rng.random() < 0.3
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = "system" if opening and turn == 0 else rng.choice(["user", "assistant", "user", "assistant", "tool", None, "", "system"])
            out.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(said) if conv is None or conv < 20 else f"t{rng.randrange(2)}.", *CLASH))
            turn += rng.choice([1, 1, 1, 2, 0])
    out += [(7, 3, "user", "same.", *CLASH)] * 3
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(conversations(), TURNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TURNS)


# --- structure repair -------------------------------------------------------------------------------------------------------


def all_edits(symbols, most_cost):
    """Every legal edit string of at most this cost, by trying all."""
    found = []

    def go(i, out, cost, edits):
        if cost > most_cost:
            return
        if i == len(symbols):
            body = out[1:] if out[:1] == "s" else out
            if (out == "" or body != "") and body == "ua" * (len(body) // 2):
                found.append((cost, edits))
        for role in "ua":
            go(i, out + role, cost + 2, edits + "I")
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, out, cost + 3, edits + "D")
            if s != "d":
                more = s.isupper()
                if s.lower() != "x":
                    go(i + 1, out + s.lower(), cost + more, edits + "K")
                for role in "ua":
                    go(i + 1, out + role, cost + 2 + more, edits + "R")

    go(0, "", 0, "")
    return min(found, default=None)


def test_least_of_all_cheapest_edits():
    rng = random.Random(1)
    cases = ["".join(x) for n in range(3) for x in itertools.product("dsuaxSUAX", repeat=n)]
    cases += ["".join(rng.choice("dsuaxSUAX") for _ in range(rng.choice([3, 4]))) for _ in range(60)]
    for symbols in cases:
        cost, edits = cheapest_edits(symbols)
        assert all_edits(symbols, cost) == (cost, edits), symbols


def damaged(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own = by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if draw == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if draw == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2]))) for c, v in by_conv.items()}


def audited(rows):
    seen, symbols, faults = set(), "", Counter()
    for _, role, text in rows:
        tail = text.rstrip(SPACE)[-1:]
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = cheapest_edits(symbols)
    numbers = [t for t, _, _ in rows if t is not None]
    left, out = list(rows), []
    for letter in audit:
        wanted = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((wanted, ""))
        else:
            _, role, text = left.pop(0)
            if letter != "D":
                out.append((role if letter == "K" else wanted, text))
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, out


def test_audit_and_repair(turns, none):
    want = {c: audited(rows) for c, rows in damaged(conversations()).items()}
    rows = audit_structure(damage(turns)).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert {k: v for k, v in r.asDict().items() if k != "conv_id"} == want[r["conv_id"]][0]
    repaired = defaultdict(list)
    for r in sorted(repair_structure(damage(turns)).collect(), key=lambda r: r["turn"]):
        repaired[r["conv_id"]].append((r["role"], r["text"]))
    assert repaired == {c: out for c, (_, out) in want.items() if out}
    assert audit_structure(damage(none)).count() == 0 == repair_structure(damage(none)).count()


def test_conversation_without_rows(spark):
    gone = spark.createDataFrame([(4, 1, "user", "a.", False)], "conv_id long, turn long, role string, text string, present boolean")
    (row,) = audit_structure(gone).collect()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (4, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i}.") for i in range(2000)] + [(2, i, "user", "x") for i in range(5)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r["conv_id"]: r for r in audit_structure(df).collect()}
        for conv in (1, 2):
            want, _ = audited([(t, r, x) for c, t, r, x in rows if c == conv])
            assert {k: v for k, v in got[conv].asDict().items() if k != "conv_id"} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- prefix trie ------------------------------------------------------------------------------------------------------------


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def nodes_of(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        seq = tuple(convs[c])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = Counter()
    for seq, own in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        kids = lambda s: sum(len(x) == len(s) + 1 and x[: len(s)] == s for x in members)
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        out[own[0], len(seq), members[seq[:-1]][0] if seq else None, len(own), kids(seq), sum(kids(s) == 0 for s in below), saved, hashlib.sha256(",".join(map(str, ends[seq])).encode()).hexdigest()] += 1
    return out


def test_trie_of_rebuilt_conversations(spark, turns, none):
    rows, ids = share_heads(turns)
    got = Counter(map(tuple, prefix_trie(rows, ids, [F.col("whose"), F.col("depth")]).collect()))
    assert got == nodes_of(rebuilt(conversations()))
    rows, ids = share_heads(none)
    assert prefix_trie(rows, ids, [F.col("whose"), F.col("depth")]).count() == 0


def test_trie_over_many_partitions_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rng = random.Random(2)
        line = [("user", f"word {rng.randrange(3)}") for _ in range(300)]
        convs = {1: line, 2: line[:170], 3: line[:170] + [("user", "other")] * 9, **{c: line[:2] for c in range(10, 60)}, 99: []}
        rows = [(c, i, r, t) for c, seq in convs.items() for i, (r, t) in enumerate(seq)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
        ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
        got = Counter(map(tuple, prefix_trie(turn_rows(df), ids, [F.col("turn"), F.col("role"), F.col("digest")]).collect()))
        assert got == nodes_of(convs)
    finally:
        for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    chain = spark.range(0, 100).select(F.col("id").cast("string").cast("binary").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string").cast("binary")).alias("parent"), F.col("id").alias("depth"), F.lit(1).cast("long").alias("v"))
    scratch = Scratch(spark, "chain")
    got = {bytes(r["node"]): r["v"] for r in subtree_sums(chain, scratch, ["v"], 99).collect()}
    assert got == {str(i).encode(): 100 - i for i in range(100)}
    assert scratch._n == 1 + math.ceil(math.log2(100))


# --- sharding ---------------------------------------------------------------------------------------------------------------


def lies(tree, key):
    """The shard by the rule, one draw at a time."""
    key = "" if key is None else str(key)
    at, level = "", 0
    while level < 3:
        weight = Counter()
        for s in tree:
            path = (s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}")
            if (path[level - 1] if level else "") == at and s.weight:
                weight[path[level]] += s.weight
        draw = lambda path: -math.log((int(hashlib.md5(f"{path}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / weight[path]  # noqa: E731, B023
        at, level = min(weight, key=draw), level + 1
    return int(at.rsplit("/", 1)[1])


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    rows = [(i * 7, "é" * rng.randrange(9) + "t" * rng.randrange(50), "k", 1) for i in range(500)]
    rows += [(None, f"no id {i}", None, 0) for i in range(5)] + [(3, "again", "x", 2)] * 40 + [(5, None, "", 1), (6, "", "", 1), (8, "long " * 20_000, "", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(5)


def test_placement(spark, texts):
    rows, df = texts
    tree = [Shard("a", "r1", 0, 1.0), Shard("a", "r1", 1, 2.0), Shard("a", "r2", 2, 0.5), Shard("b", "r1", 3, 1.5), Shard("b", "r1", 4, 0.0)]
    grown = with_shard(tree)
    got = place(df, tree, grown, bins=3, piece=7).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", lies(tree, i), lies(grown, i)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = place(df.coalesce(1), tree, grown, bins=3, piece=7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got) and any(r["grown_shard"] == 5 for r in got)
    assert place(df.limit(0), tree, grown).count() == 0


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    tree = even_tree(2, 2, 3)
    heavier = [s._replace(weight=3.0) if s.shard == 4 else s for s in tree]
    rows = place(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), tree, heavier).collect()
    region, rack = ({s.shard: x for s, x in ((s, getattr(s, n)) for s in tree)} for n in ("region", "rack"))
    moved = [(r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]]
    assert moved
    for a, b in moved:
        assert region[b] == region[4]  # nothing moves to a region that weighs no more
        if region[a] == region[b]:
            assert rack[b] == rack[4] and (rack[a] != rack[b] or b == 4)
    share = Counter(r["shard"] for r in rows)
    assert all(abs(n / 4000 - 1 / 12) < 0.02 for n in share.values())
    share = Counter(r["grown_shard"] for r in rows)
    assert abs(share[4] / 4000 - 3 / 14) < 0.03


def test_tree_errors(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for bad in ([], [Shard("a", "b", 0, 0.0)], [Shard("a", "b", 0), Shard("a", "c", 0)], [Shard("a", "b", 0, -1.0)]):
        with pytest.raises(ValueError):
            place(df, bad, even_tree(1, 1, 1))
