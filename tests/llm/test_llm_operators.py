"""Each operator against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docengine.llm import lm_score, ngram_join
from docengine.llm.chat_format import field_paths, fingerprint, fingerprint_of, format_turns, pick, read_loss, read_turns, turns_from_frame, turns_from_json, unmapped
from docengine.llm.common import Scratch
from docengine.llm.components import connected_components
from docengine.llm.decontaminate import find_leaks
from docengine.llm.exact_dedup import content_sort_dedup
from docengine.llm.mixing import cycle_weights, mix, route, source_targets, water_fill
from docengine.llm.ngram_join import ngram_jaccard_join
from docengine.llm.quality import Settings as QualitySettings
from docengine.llm.quality import cotrain_and_score
from docengine.llm.secret_scan import candidates, example_findings, scan_secrets
from docengine.llm.suffix_dedup import repeated_substring_cut
from docengine.llm.url_filters import Rule, match_urls, parse_rule

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, at string, label int, row string, size string, good string, draw int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(3)
    base = prose(rng, 120)
    out = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    out += [base] * 5 + [base.replace(" ", "\n", 7), "  " + base + "\t"]
    for k in range(12):  # near copies, some beyond the threshold
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    shared = prose(rng, 25, 10_000)
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 10) for _ in range(6)]
    out += [None, "", " \n\t", "a b c", "A b C", "é" * 60, "é" * 61, "za " * 3000, "abcd" * 40]
    return out


def rows():
    clash = (7, "k", "a", 1, "r", "s", "g", 2)
    out = []
    for i, t in enumerate(texts()):
        doc_id = 10 * i + 3
        out.append((doc_id, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None if i % 5 == 0 else len(t or ""), *clash))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for doc_id, t, *_ in rows():
        groups[re.sub("[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), doc_id))
    got = table(content_sort_dedup(docs))
    assert len(got) == len(rows())
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            assert got[doc_id] == {"doc_id": doc_id, "keep_id": keep, "group_size": len(members), "kept": doc_id == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()}
    assert content_sort_dedup(empty).count() == 0


def test_exact_dedup_of_a_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x y").otherwise(F.col("id").cast("string")).alias("text"))
    got = table(content_sort_dedup(df.repartition(7)))
    same = [r for i, r in got.items() if i % 3 == 0]
    assert {r["keep_id"] for r in same} == {0} and {r["group_size"] for r in same} == {1000} and sum(r["kept"] for r in same) == 1
    twice = content_sort_dedup(df.unionByName(df).where("doc_id < 10"))
    assert twice.where("kept").select("doc_id").distinct().count() == twice.where("kept").count()


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(docs, empty):
    sets = {r[0]: shingle_set(r[1]) for r in rows()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a2, b2 = sorted((find(a), find(b)))
                parent[b2] = a2
    got = table(ngram_jaccard_join(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_jaccard_join(empty).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rng = random.Random(5)
    base = prose(rng, 150, 9_000).split()
    data = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in data]
    parent = list(range(len(data)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = table(ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(4)))
    assert [got[i]["component_id"] for i in range(len(data))] == [find(i) for i in range(len(data))]


def test_leaks_with_insertions_cuts_and_changes(spark):
    rng = random.Random(21)
    items = [(i, " ".join(f"t{rng.randrange(5000)}" for _ in range(rng.randrange(16, 60)))) for i in range(30)]
    pad = lambda k: " ".join(f"pad{rng.randrange(10**6)}" for _ in range(k))
    made = []
    for i, text in items:
        w = text.split()
        for k in range(1, 13):
            for at in (len(w) // 2, rng.randrange(1, len(w))):
                made.append((f"{k} words added", i, " ".join([*w[:at], pad(k), *w[at:]])))
        made += [("first 0.6", i, " ".join(w[: int(0.6 * len(w))])), ("last 0.7", i, " ".join(w[int(0.3 * len(w)) :])), ("two parts", i, " ".join([*w[: len(w) // 2], pad(30), *w[len(w) // 2 :]]))]
        changed = list(w)
        changed[rng.randrange(len(w))] = "other"
        made.append(("a word changed", i, " ".join(changed)))
    docs = spark.createDataFrame([(n, f"{pad(12)} {t} {pad(12)}") for n, (_, _, t) in enumerate(made)] + [(10_000 + i, " ".join(x.split()[:9])) for i, x in items], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(made[d][1] == i for d, i in got)  # no other item, and none for nine words of an item
    kinds = Counter(kind for kind, *_ in made if kind != "two parts")
    hits = Counter(made[d][0] for d, _ in got)
    assert all(hits[kind] >= 0.9 * n for kind, n in kinds.items()), hits


def test_items_of_one_template_are_one_class(spark):
    say = lambda a, b, name: f"in the old mill {a} bags of flour were sold to {name} for {b} euros before the bell rang for the last time"
    items = [(i, say(i % 60 + 2, i // 60 + 200, ("Anna", "Bert Meyer", "Carl")[i % 3])) for i in range(1500)]
    docs = [(0, say(7, 203, "Carl")), (1, say(9_000, 8_000, "Anna")), (2, items[661][1]), (3, "nothing of this kind was ever said about the old mill"), (4, say(5, 201, "Anna").lower())]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["kind"]): r["item_id"] for r in found}
    text = dict(items)
    assert text[got[0, "verbatim"]] == docs[0][1] and text[got[2, "verbatim"]] == docs[2][1] and text[got[4, "verbatim"]].lower() == docs[4][1]
    # names of one word and of two are two templates
    assert sorted(r["item_id"] for r in found if r["doc_id"] == 1) == [0, 1]
    assert not [r for r in found if r["doc_id"] == 3] and len(found) <= 9


def test_ngram_join_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60, 9_000) for _ in range(4))
    near = lambda text: text + f" w{rng.randrange(10**6)}"
    data = [(1, a), (1, b), (2, near(b)), (3, near(a)), (4, c), (5, near(c)), (5, d), (6, near(d)), (6, near(d)), (7, None), (7, ""), (8, f"{b} {a}"), (1, f"{b} {a}"), (None, near(c)), (None, c), (9, prose(rng, 3)), (9, None)]
    data += [(rng.randrange(20, 30), near(rng.choice([prose(rng, 40, 9_000), c]))) for _ in range(25)]
    sets = [shingle_set(t) for _, t in data]
    parent = {i: i for i, _ in data if i is not None}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for (i, _), s in zip(data, sets, strict=True):
        for (j, _), t in zip(data, sets, strict=True):
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = Counter(map(tuple, ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()))
    equal = lambda s: [find(i) for (i, _), t in zip(data, sets, strict=True) if i is not None and t == s and s]
    want = Counter((i, len(s), find(i) if i is not None else min(equal(s), default=None)) for (i, _), s in zip(data, sets, strict=True))
    assert got == want


@pytest.mark.parametrize(("hot_rows", "open_rows"), [(2, 1), (6, 3), (10, 2_000), (50_000, 2)])
def test_ngram_join_at_hot_tokens(spark, monkeypatch, hot_rows, open_rows):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(ngram_join, "OPEN_ROWS", open_rows)
    rng = random.Random(8)
    data = []
    for _ in range(4):
        base = prose(rng, 120, 9_000).split()
        data += [" ".join(base)] * 30
        for k in range(8):  # near copies, the last ones beyond the threshold
            w = list(base)
            for at in rng.sample(range(len(w)), 1 + k // 2):
                w[at] = f"y{rng.randrange(10**6)}"
            data.append(" ".join(w))
    boiler = prose(rng, 34, 9_000)  # in many long texts, and the most of some short ones
    data += [f"{prose(rng, 90, 9_000)} {boiler} {prose(rng, 60, 9_000)}" for _ in range(30)]
    data += [f"{boiler} {prose(rng, k, 9_000)}" for k in (1, 2, 2, 1, 3, 9)]
    sets = [shingle_set(t) for t in data]
    parent = list(range(len(data)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = table(ngram_jaccard_join(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)))
    assert [got[i]["component_id"] for i in range(len(data))] == [find(i) for i in range(len(data))]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {r["id"]: r["label"] for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def brute_cut(data, length=50):
    first, out = {}, {}
    for doc_id, t in sorted(data):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], doc_id) < doc_id:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc_id] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_substring_cut(docs).collect()}
    assert got == brute_cut([(r[0], r[1]) for r in rows()])
    assert repeated_substring_cut(empty).count() == 0


def test_suffix_dedup_of_short_and_touching_repeats(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [letters(n) for n in (49, 50, 51, 60, 84, 200)]
    data = [(i, letters(rng.randrange(90)) + "".join(rng.sample(parts, 3)) + letters(rng.randrange(90))) for i in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_substring_cut(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_cut(data)


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long, other = letters(9_000), letters(300)
    data = [(1, long), (2, long), (2, letters(70)), (2, other), (2, other), (3, letters(20) + other[:120]), (None, long), (None, long), (4, None), (4, ""), (4, long[:49]), (1, long)]
    first: dict[bytes, int] = {}
    for i, t in data:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = []
    for i, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in repeated_substring_cut(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lm_score(docs, empty):
    small = lm_score.Settings(classes=4, cells=4, rare_classes=2, least_rows=64, most_rows=64, frequent=50, steps=2, batch=512)
    got = table(lm_score.lm_score(docs, small))
    tokens = {r[0]: WORD.findall((r[1] or "").translate(LOWER)) + ["\0end"] for r in rows()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts))
        assert r["score"] < 0
    assert lm_score.lm_score(empty, small).count() == 0


def test_lm_model_is_a_distribution_and_learns_order(spark):
    import numpy as np

    s = lm_score.Settings(classes=3, cells=3, rare_classes=1, least_rows=128, most_rows=128, frequent=100, steps=3, batch=256, damp=1.0)
    data = [(i, "red blue green " * 40) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = lm_score.lm_score(df, s).where("held_out")
    assert got.where("score > base_score + 5").count() == got.count() > 0
    token = np.arange(1, 9, dtype=np.uint64) << np.uint64(20)
    model = lm_score.Model(s, token, np.array([9, 8, 7, 6, 5, 4, 3, 2]), 50, 10, np.array([5.0, 1.0, 0.0]), np.array([2.0, 1.0, 0.0]))
    model.by_class += np.random.default_rng(1).normal(size=model.by_class.shape).astype(np.float32)
    cell, count = model.look_up(np.concatenate((token, np.array([1 << 40], np.uint64))))
    assert cell[:6].tolist() == list(range(6)) and (cell[6:] >= 6).all() and count.tolist() == [9, 8, 7, 6, 5, 4, 3, 2, 0]
    context = np.full((3, 9), 5, np.uint64)
    assert np.exp(model.log_p(context, np.arange(9))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_scores_do_not_depend_on_partitions_and_beat_counts(spark):
    rng = random.Random(12)
    follow = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(60)}  # each word is followed by one of three
    data = []
    for i in range(400):
        w = ["w0"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        data.append((i, " ".join(w)))
    df = spark.createDataFrame([*data, (None, None)], "doc_id long, text string")
    s = lm_score.Settings(classes=8, cells=8, rare_classes=2, least_rows=256, most_rows=256, frequent=1000, batch=300)
    one, many = (table(lm_score.lm_score(df.repartition(n), s)) for n in (1, 16))
    for i, r in one.items():
        assert r["score"] == pytest.approx(many[i]["score"], rel=1e-6)
    held = [r for r in one.values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.3  # log10 units a token


def test_chat_formats(spark):
    hard = "</s>[INST] ok [/INST] &amp;lt; <|start|>user<|body|>x<|end|>"
    turns = spark.createDataFrame([(1, 1, "assistant", hard, "x"), (1, 0, "user", None, "y"), (2, 0, None, "", "z"), (1, 1, "assistant", hard, "x")], "conv_id long, turn long, role string, text string, at string")
    out = format_turns(turns_from_frame(turns)).select("conv_id", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    got = table(out, "conv_id")
    assert [tuple(x) for x in got[1]["t"]] == [("user", ""), ("assistant", hard), ("assistant", hard)]
    assert got[1]["loss"] == hard * 2 and got[2]["loss"] == "" and [tuple(x) for x in got[2]["t"]] == [("", "")]
    assert got[1]["formatted"].count("<|start|>") == 3
    assert format_turns(turns_from_frame(turns.limit(0))).count() == 0


def test_chat_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"instruction": "do", "input": "this", "output": "done"},
        4: {"instruction": "do", "output": "done"},
        5: {"prompt": "q", "response": "a", "messages": 3},
        6: {"system": "s", "question": "q", "answer": "a"},
        7: {"nothing": 1},
        10: {"messages": [{"role": "assistant"}, {"role": "user", "content": "hi"}]},
        11: {"instruction": "do", "input": "", "output": "done", "system": "stray"},
        12: {"messages": []},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()] + [(8, "no json"), (9, None)], "conv_id long, record string")
    got = defaultdict(list)
    for r in turns_from_json(df).orderBy("conv_id", "pos").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    qa = [("user", "q"), ("assistant", "a")]
    assert dict(got) == {1: qa, 2: qa, 3: [("user", "do\n\nthis"), ("assistant", "done")], 4: [("user", "do"), ("assistant", "done")], 5: qa, 6: [("system", "s"), *qa], 10: [("assistant", ""), ("user", "hi")], 11: [("user", "do"), ("assistant", "done")]}
    assert {r["conv_id"]: r["reason"] for r in unmapped(df).collect()} == {7: "unknown layout", 12: "unknown layout", 8: "no json", 9: "no json"}
    assert turns_from_json(df.limit(0)).count() == 0 and unmapped(df.limit(0)).count() == 0
    assert turns_from_json(df.unionByName(df)).count() == 2 * turns_from_json(df).count()
    hashed = spark.range(1).select(fingerprint(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0]
    assert hashed == fingerprint_of(["a", "b"])
    typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert pick(field_paths(typed.schema)).name == "messages"
    rows_ = spark.createDataFrame([(None, 1, "human", "a"), (None, 0, "gpt", "b"), (3, None, "x", "c")], "conv_id long, turn int, role string, text string")
    assert sorted((str(r["conv_id"]), r["pos"], r["role"]) for r in turns_from_frame(rows_).collect()) == [("3", 1, "x"), ("None", 1, "gpt"), ("None", 2, "human")]
    assert [(r["role"], r["text"]) for r in turns_from_frame(typed).orderBy("pos").collect()] == [("user", "q"), ("assistant", "")]


def test_decontamination(spark):
    item = "A train leaves Paris at 40 km per hour and meets Anna after 3 hours near Paris station today."
    other = "Seven wizards counted the golden apples while nobody in the quiet village was looking at them."
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (3, None, "x"), (4, "too short", "x")], "item_id long, text string, coverage string")
    data = [
        (1, "intro. " + item + " outro"),
        (2, "x. A train leaves London at 75 km per hour and meets Bob after 9 hours near London station today. y"),
        (3, "text " + other.upper() + " text"),
        (4, "A train is late. Anna counted apples after 3 hours in the village near Paris."),
        (5, None),
        (6, ""),
        (1, "intro. " + item + " outro"),
    ]
    docs = spark.createDataFrame([(*r, "e") for r in data], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (3, 2): "verbatim"}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, block_items=1).collect()} == set(got)
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_with_values_of_other_lengths(spark):
    number = "we know that every worker in this large factory packs 40 boxes during one long shift before lunch is served"
    names = "yesterday the old baker sold Anna twelve fresh rolls and then went to Paris with all the money that he had"
    words = "seven quiet wizards counted the golden apples while nobody in the small village was looking at them or at their hats"
    bench = spark.createDataFrame([(1, number), (2, names), (3, words), (4, "It costs 1,200 or 42.5")], "item_id long, text string")
    data = [
        (1, number.replace("40", "42.5"), 1),
        (2, number.replace("40", "-1,200,000.75"), 1),
        (3, names.replace("Anna", "Mary Ann").replace("Paris", "New York"), 2),
        (4, names.replace("Anna", "Mary Ann").replace("Paris", "New York").lower(), None),
        (5, words.replace("nobody", "nobody else"), 3),
        (6, words.replace("golden apples while", "apples while"), 3),
        (7, " ".join(reversed(words.split())), None),
        (8, "\u2212", None),
        (9, "now: It costs 1,200 or 42.5", 4),
    ]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, bench).collect()}
    assert set(got) == {(d, i) for d, _, i in data if i}
    assert [got[k]["kind"] for k in ((1, 1), (3, 2), (5, 3), (9, 4))] == ["reparameterised", "reparameterised", "verbatim", "verbatim"]
    assert (got[3, 2]["slots"], got[3, 2]["slots_changed"], got[3, 2]["coverage"]) == (2, 2, 1.0)
    # a run of names in lower case is told by its words
    whole = spark.createDataFrame([(1, names.replace("Paris", "New York"))], "item_id long, text string")
    assert find_leaks(spark.createDataFrame([(1, names.replace("Paris", "New York").lower())], "doc_id long, text string"), whole).count() == 1


def test_decontamination_of_short_items(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "x = 5"), (3, "!?"), (4, "")], "item_id long, text string")
    data = [(1, "Quiz. Who wrote Hamlet? Nobody knows."), (2, "I know who wrote Hamlet and when."), (3, "who wrote hamlet"), (4, "so:\nx = 5\nis it"), (5, "so:\nx = 7\nis it"), (6, "!?"), (7, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = {(1, 1), (3, 1), (4, 2)}
    for limits in ({}, {"block_items": 1}, {"block_bytes": 3}):
        assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, **limits).collect()} == want


def test_contradicting_slots_are_no_leak(spark):
    item = "Add 5 to 5 and then take 5 from the sum of 5 and 5 to get the final result of 5."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    wild = "Add 1 to 2 and then take 3 from the sum of 4 and 6 to get the final result of 7."
    docs = spark.createDataFrame([(1, item.replace("5", "9")), (2, wild)], "doc_id long, text string")
    assert [r["doc_id"] for r in find_leaks(docs, bench).collect()] == [1]


def url_brute(rules, url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
    fits = [r for r in rules if (r.host == host or host.endswith("." + r.host) or r.host == "") and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.verdict == "block", len(r.host)), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_url_filters(spark):
    rng = random.Random(1)
    rules = [parse_rule(x) for x in ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block ample.com/", "allow a.net/es/x", "block com/en/")]
    hosts = ["example.com", "www.example.com", "EXAMPLE.com:80", "a.net", "b.a.net", "xexample.com", "com", "net", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x?q', '/es/#f', '/en/a b'])}" for _ in range(300)] + [None, "", "no scheme/en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(5)
    for block in (1000, 2):
        got = {r["page_id"]: tuple(r)[1:] for r in match_urls(pages, rules, block=block).collect()}
        assert got == {i: url_brute(rules, u) for i, u in enumerate(urls)}
    assert match_urls(pages.limit(0), rules).count() == 0
    assert match_urls(pages, []).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert Rule("block", "a.b", "/c").key == "b.a."


def test_url_rules_of_equal_length(spark):
    sets = [["block com/abcde", "allow x.com/abc"], ["allow com/a", "block com/a"], ["allow x.com/ab", "allow com/abcd"], ["block x.com/", "block com/abc", "allow com/abc"]]
    urls = ["http://x.com/abcde", "http://y.com/abcde", "http://x.com/ab", "http://x.com/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for lines in sets:
        for order in (lines, lines[::-1]):
            rules = [parse_rule(x) for x in order]
            for block in (1, 2, 100):
                got = {r["page_id"]: tuple(r)[1:] for r in match_urls(pages, rules, block=block).collect()}
                assert got == {i: url_brute(rules, u) for i, u in enumerate(urls)}


def test_water_fill_and_targets():
    assert water_fill(100, [5, 2, 1], [1000, 1000, 1000]) == [62.5, 25.0, 12.5]
    assert water_fill(80, [5, 2, 1], [10, 100, 100]) == [10.0, pytest.approx(140 / 3), pytest.approx(70 / 3)]
    assert sum(water_fill(60, [5, 2, 1], [6, 27, 57])) == pytest.approx(60)
    assert list(source_targets({"b": 5, None: 1, "a": 9}, cycle_weights((5, 2, 1)))) == ["a", "b", None]


def test_flow_prefers_fresh_text():
    flow = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(flow.values()) == 30 and max(flow.values()) == 10
    flow = route({("a",): 10}, {"a": 25})
    assert flow[("a",)] == 25


def test_mixing(docs, empty):
    got = mix(docs, cycle_weights((5, 2, 1)), F.array("source")).collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    own = defaultdict(int)
    for r in rows():
        own[r[3]] += sizes[r[0]]
    targets = source_targets(dict(own), cycle_weights((5, 2, 1)))
    for s, target in targets.items():
        mine = [r for r in got if r["pattern"] == [s]]
        assert {(r["source_size"], round(r["target"], 6)) for r in mine} == {(own[s], round(target, 6))}
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - target) <= max(r["size"] for r in mine)
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in mine)
    again = mix(docs.repartition(5), cycle_weights((5, 2, 1)), F.array("source")).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mix(empty, cycle_weights((5, 2, 1)), F.array("source")).count() == 0
    with pytest.raises(ValueError, match="patterns"):
        mix(docs, cycle_weights((1,)), F.array("source"), max_patterns=1)


def test_quality_classifier(spark, empty):
    rng = random.Random(2)
    data, labels = [], []
    for i in range(600):
        t = prose(rng, 60)
        bad = i % 3 == 0
        if i % 6 == 0:
            t += " idiot " + prose(rng, 10)
        elif bad:
            t = " ".join(f"{w}!!" for w in t.upper().split())
        data.append((i, t, "en", f"s{i % 3}", len(t), "x"))
        if i % 2 == 0 or i % 9 == 0:
            labels.append((i, 0 if bad and i % 6 else 1, 1 if i % 6 == 0 else 0, "y"))
    data += [(1000, None, None, None, None, "x"), (1001, "", "de", "s", 0, "x"), (1002, "word " * 20_000, "en", "s0", 100_000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, content string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, good string")
    got = table(cotrain_and_score(df, lab, QualitySettings(rounds=1)))
    assert len(got) == len(data)
    clean = [got[i]["keep"] for i in range(600) if i % 3]
    bad = [got[i]["keep"] for i in range(600) if i % 3 == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(bad) / len(bad) < 0.2
    everything = cotrain_and_score(df, lab.limit(0))
    assert everything.where("keep and score is null").count() == len(data)
    assert cotrain_and_score(empty, lab).count() == 0


def test_secret_scan_in_other_surroundings(spark):
    key = "q7RzT2mKx9LwV4bNc8YpH3sGd6FjA1uEoZ5iXvB0"
    digest = hashlib.sha256(b"d").hexdigest()
    data = [
        (1, f"set password: {key} and go", key, True),
        (2, f"pasted ghp_{key[:30]} here", f"ghp_{key[:30]}", True),
        (3, f"export token={key}", key, True),
        (4, f'the checksum: "{digest}" of it', digest, False),
        (5, "login with pwd = 'aB3dE5gH9k' now", "aB3dE5gH9k", None),
        (6, "private key = 'docs/index2/service/main.html' there", "docs/index2/service/main.html", False),
    ]
    df = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    assert {r["doc_id"]: r["candidate"] for r in candidates(df).collect()} == {r[0]: r[2] for r in data}
    got = {r["doc_id"]: r["secret"] for r in scan_secrets(df, example_findings(spark)).collect()}
    assert {i: got[i] for i, _, _, secret in data if secret is not None} == {i: secret for i, _, _, secret in data if secret is not None}
    shown = example_findings(spark, 1200).select("secret", F.col("before").rlike("[\"'`]$"), F.col("before").rlike("[=:][ \"'`]*$"))
    assert shown.distinct().count() == 8


def test_secret_scan_recall_and_false_positives(spark):
    rng = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    data, want = [], {}
    for i in range(160):
        key = rng.choice(["", "ghp_", "AKIA", "sk_live_"]) + random_key(rng.choice([24, 32, 40]))
        name = rng.choice(["API_KEY", "secret", "access_token", "password"])
        text = [f"{name}={key}", f'{name} = "{key}"', f"https://host.example.org/v1?{name}={key}", f"service:\n  {name}: {key}\n"][i % 4]
        data.append((i, f"some words before {text} and some after it"))
        want[i] = key
    for i in range(160, 320):
        hexes = hashlib.sha256(str(i).encode()).hexdigest()
        plain = [f"commit {hexes[:40]}", f"sha256: {hexes}", f"see docs/index{i}/server/module/page{i}.html", f"order id 4{rng.randrange(10**17):018d}", f"uuid {hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}"][i % 5]
        data.append((i, f"some words before {plain} and some after it"))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = defaultdict(list)
    for r in scan_secrets(df, example_findings(spark)).collect():
        if r["secret"]:
            got[r["doc_id"]].append((r["start"], r["length"]))
    found = sum(any(data[i][1][at - 1 : at - 1 + n].endswith(key) for at, n in got[i]) for i, key in want.items())
    assert found / len(want) >= 0.9
    assert sum(bool(got[i]) for i in range(160, 320)) / 160 <= 0.05


def test_secret_candidates_of_a_text_full_of_keys(spark):
    runs = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3_000)]
    text = " é ".join(runs)
    got = candidates(spark.createDataFrame([(None, text), (2, "")], "doc_id long, text string")).collect()
    assert [text[r["start"] - 1 : r["start"] + 31] for r in got] == runs == [r["candidate"] for r in got]
    assert got[0]["before"] == "" and got[1]["before"] == " é " == got[1]["after"] and got[-1]["after"] == ""


def test_secret_scan(spark):
    key = hashlib.sha1(b"k").hexdigest()
    data = [
        (1, f'Some words. api token = "{key}" and more words.\nnext {key}'),
        (2, "see www.page47.example.com/docs/index/service/main.html and 9807915762804490 there"),
        (3, None),
        (4, ""),
        (5, "ordinary words only and a veryverylongordinarywordwithoutdigits here"),
        (1, "repeated row"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, candidate string")
    found = {(r["doc_id"], r["start"]): r["candidate"] for r in candidates(df).collect()}
    for (doc_id, start), c in found.items():
        assert any(t[start - 1 : start - 1 + len(c)] == c for i, t in data if i == doc_id and t)
    assert {i for i, _ in found} == {1, 2}
    got = scan_secrets(df, example_findings(spark, 1200)).collect()
    best = {r["start"]: r["secret"] for r in got if r["doc_id"] == 1}
    assert best[data[0][1].index(key) + 1] is True
    assert not any(r["secret"] for r in got if r["doc_id"] == 2)
    assert scan_secrets(df.limit(0), example_findings(spark, 600)).count() == 0
