"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose values
were changed keeps its template.  Windows of template tokens of the benchmark
items are hashed into a table that every task holds; the windows of all texts
are looked up in it while they are scanned, so no text is shuffled.  A whole
number and a run of capitalised words are one placeholder each.  Where windows
of an item line up in a document, on one diagonal or in order over neighbouring
ones (a word is added or left out), the values in their slots are compared: the same value of the item must stand for one value of the document
everywhere, which tells a re-parameterised copy from a chance likeness.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.textnp import LOWER, chunks, span_hash, spans, splitmix

_U = np.uint64

#: Template tokens in a window; a shorter item is one window of its whole length.
WINDOW = 8

#: Fewest words of an item that is looked for by its template; a shorter one must be a whole sentence with the same values.
SHORTEST = 5

#: Benchmark items and bytes in one block, on average: a block's windows are held by every task.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 4 << 20

#: Share of an item's tokens that windows in order must cover in a document, and the windows that this takes (all, where an item has fewer).
COVERAGE = 0.5
FEWEST = 3

#: Share of the tokens for which two windows are enough.
MOST_OF_IT = 0.75

#: Tokens by which two windows of an item that follow each other may be nearer or farther in a document, or as many as a longer item has.
DRIFT = 16

#: Units that follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l ms s sec min h hr hour hours day days week weeks month months year years "
    "minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms litre litres liter liters "
    "percent usd eur dollar dollars euro euros cent cents hz khz mhz ghz v kv mv a ma w kw mw j kj n pa kpa c f k deg degree degrees"
).split()

#: Placeholder codes; 0 is an ordinary word.
NUMBER, NAME, UNIT = 1, 2, 3

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x80:] = True
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _WORD_BYTE[_lo:_hi] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F, 0x0A]] = True  # ! . : ? and line feed end a sentence
_MARK, _SIGN, _LINK, _BEFORE = (np.zeros(256, bool) for _ in range(4))
_MARK[[0x2C, 0x2E]] = True  # , . inside a number
_SIGN[[0x2B, 0x2D]] = True  # + -
_LINK[[0x20, 0x27, 0x2D]] = True  # space ' - inside a name
_BEFORE[[0x09, 0x0A, 0x0D, 0x20, 0x28, 0x3D]] = True  # white space ( = before a sign

_PLACEHOLDER = splitmix(np.arange(1, 5, dtype=_U))
_STEP = _U(0xA0761D6478BD642F)
_UNIT_HASH = np.sort(np.array([span_hash(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)]))[0] for u in UNITS], _U))


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


class Template:
    """Template tokens of a chunk: kind, hash, value span and document of each.

    There are two forms.  In form 0 a run of names is one token; in form 1 names
    are words.  ``base[0]`` has the form-1 index at which a form-0 token begins,
    ``run`` the form-0 index of a form-1 token.
    """

    def __init__(self, chunk):
        data = chunk.data
        start, end, doc = spans(_WORD_BYTE[data], chunk)
        self.n_words = np.bincount(doc, minlength=chunk.n_docs)
        # U+2212, a minus of three bytes, is part of the span
        ahead = np.concatenate((data, np.zeros(3, np.uint8)))
        minus = (ahead[start] == 0xE2) & (ahead[start + 1] == 0x88) & (ahead[start + 2] == 0x92) & _DIGIT[ahead[start + 3]]
        first = np.ones(len(start), bool)
        if len(start):
            digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
            whole = digits[end] - digits[start] == end - start - 3 * minus
            first[1:] = ~(whole[:-1] & _DIGIT[data[start[1:]]] & (start[1:] == end[:-1] + 1) & _MARK[data[end[:-1]]] & (doc[1:] == doc[:-1]))
        self.start, self.end, self.doc = start[first], end[np.append(first[1:], True)] if len(end) else end, doc[first]
        number = _DIGIT[data[self.start]] | minus[first]
        at = self.start - 1
        signed = number & (at >= chunk.doc_start[self.doc])
        signed[signed] = _SIGN[data[at[signed]]] & ((at[signed] == chunk.doc_start[self.doc[signed]]) | _BEFORE[data[at[signed] - 1]])
        self.start = self.start - signed
        n = len(self.start)
        # A-Z and the two-byte capitals of Latin-1
        two = np.zeros(len(data), bool)
        two[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        upper = _UPPER[data] | two
        self.data = LOWER[data]
        self.data[1:][two[:-1]] += 0x20
        self.value = span_hash(self.data, self.start, self.end)
        self.kind = np.zeros(n, np.int8)
        opens = np.ones(n, bool)
        if n:
            stops = np.concatenate(([0], np.cumsum(_STOP[data])))
            # begins a sentence, where a capital says nothing
            opens[1:] = (stops[self.start[1:]] > stops[self.end[:-1]]) | (self.doc[1:] != self.doc[:-1])
            capitals = np.concatenate(([0], np.cumsum(upper)))
            one = (capitals[self.end] - capitals[self.start] == 1) & upper[self.start]
            long = self.end - self.start > 1 + two[self.start]
            self.kind[one & long & ~opens] = NAME
            self.kind[number] = NUMBER
            unit = _isin(self.value, _UNIT_HASH)
            unit[0] = False
            unit[1:] &= number[:-1] & (self.doc[1:] == self.doc[:-1])
            self.kind[unit & ~number] = UNIT
        typed = np.where(self.kind > 0, _PLACEHOLDER[self.kind], self.value) if n else np.zeros(0, _U)
        # Where a copy changed its capitals, names are not told from words: the second form keeps them as words.
        plain = np.where(self.kind == NAME, self.value, typed)
        begins = np.ones(n, bool)
        if n:
            name = self.kind == NAME
            begins[1:] = ~(name[1:] & name[:-1] & (self.doc[1:] == self.doc[:-1]) & (self.start[1:] == self.end[:-1] + 1) & _LINK[data[self.end[:-1]]])
        self.base = (np.flatnonzero(begins), np.arange(n))
        self.run = np.cumsum(begins) - 1
        self.run_end = self.end[np.append(begins[1:], True)] if n else self.end
        self.forms = (typed[begins], plain)
        self.docs = (self.doc[begins], self.doc)
        self.opens = tuple(np.append(x, True) for x in (opens[begins], opens))

    def whole_sentence(self, form: int, token: int, width: int) -> bool:
        """Whether the window is no part of a longer sentence."""
        return bool(self.opens[form][token] and self.opens[form][token + width])

    def windows(self, width: int, form: int) -> np.ndarray:
        """Hash of each window of ``width`` tokens; windows over a document's end are dropped by the caller."""
        token = self.forms[form]
        n = len(token) - width + 1
        if n <= 0:
            return np.zeros(0, _U)
        acc = token[:n].copy()
        for k in range(1, width):
            acc *= _STEP
            acc += token[k : n + k]
        return splitmix(acc + _U(width))

    def text(self, i: int, form: int) -> str:
        start, end = (self.start[self.base[0][i]], self.run_end[i]) if form == 0 else (self.start[i], self.end[i])
        return self.data[start:end].tobytes().decode("utf-8", "replace")


class Item:
    """The slots of a benchmark item and where its tokens of each form begin."""

    def __init__(self, t: Template, bounds: list[tuple[int, int]]):
        (lo, hi), (lo1, hi1) = bounds
        self.widths = [min(hi - lo, WINDOW), min(hi1 - lo1, WINDOW)]
        self.n_windows = [hi - lo - self.widths[0] + 1, hi1 - lo1 - self.widths[1] + 1]
        self.base = (t.base[0][lo:hi] - lo1, np.arange(hi1 - lo1))
        self.run = t.run[lo1:hi1] - lo
        self.kind = t.kind[t.base[0][lo:hi]]
        self.values = [t.text(j, 0) for j in range(lo, hi)]
        self.plain = {j - lo1: t.text(j, 1) for j in range(lo1, hi1) if t.kind[j]}
        self.n_tokens = [hi - lo, hi1 - lo1]
        first: dict[tuple[int, str], int] = {}
        same = [first.setdefault((int(k), v), j) if k else -1 for j, (k, v) in enumerate(zip(self.kind, self.values, strict=True))]
        #: Items of one template: the same tokens and runs, and equal values in the same places.
        self.template = (t.forms[0][lo:hi].tobytes(), self.base[0].tobytes(), tuple(same))
        self.short = hi1 - lo1 < SHORTEST
        self.drift = max(DRIFT, hi1 - lo1)

    def share(self, windows: list[set[int]]) -> float:
        """Share of the tokens under the windows, by the form in which it is larger; 0 for too few windows.

        ``windows``: by form, the form-1 token at which each begins.
        """
        best = 0.0
        for form, begins in enumerate(({int(self.run[b]) for b in windows[0]}, windows[0] | windows[1])):
            width, under, end = self.widths[form], 0, 0
            for at in sorted(begins):
                under += at + width - max(at, end)
                end = at + width
            share = min(1.0, under / self.n_tokens[form])
            if len(begins) >= min(FEWEST, self.n_windows[form]) or (len(begins) > 1 and share >= MOST_OF_IT):
                best = max(best, share)
        return best


class WindowTable:
    """The windows of a block of benchmark items, by width and hash.

    Items of one template are a class.  Its first item stands for all of them:
    windows that several members have are there once, under the first of these,
    and a value leads to the members that have it in a slot.
    """

    def __init__(self, ids: list[int], texts: list[str]):
        found = defaultdict(list)
        self.items: dict[int, Item] = {}
        self.first: dict[int, int] = {}  # of each item's class
        self.members: dict[int, dict[tuple[int, str], set[int]]] = {}  # of each class of several, by slot and value
        classes: dict[tuple, list[int]] = {}
        at = 0
        for chunk in chunks(pa.array(texts, pa.string())):
            t = Template(chunk)
            lo = [np.searchsorted(d, np.arange(chunk.n_docs), side="left") for d in t.docs]
            hi = [np.searchsorted(d, np.arange(chunk.n_docs), side="right") for d in t.docs]
            for i in range(chunk.n_docs):
                if not t.n_words[i]:
                    continue
                bounds = [(int(lo[form][i]), int(hi[form][i])) for form in (0, 1)]
                item = Item(t, bounds)
                own = classes.setdefault(item.template, [])
                own.append(at + i)
                self.items[at + i], self.first[at + i] = item, own[0]
                for form, (begin, end) in enumerate(bounds):
                    if form == 0 and len(own) > 1:
                        continue  # the first item's windows
                    width = item.widths[form]
                    hashes = t.windows(width, form)[begin : end - width + 1]
                    found[width, form].append((hashes, np.full(len(hashes), at + i), np.arange(len(hashes)), np.full(len(hashes), own[0])))
            at += chunk.n_docs
        self.ids = ids
        for own in classes.values():
            if len(own) > 1:
                slots = self.members[own[0]] = defaultdict(set)
                for number in own:
                    for j, (kind, value) in enumerate(zip(self.items[number].kind, self.items[number].values, strict=True)):
                        if kind:
                            slots[j, value].add(number)
        self.by_form = {}
        for form, parts in found.items():
            h, item, pos, head = (np.concatenate([p[i] for p in parts]) for i in range(4))
            by = np.lexsort((item, pos, head, h))
            h, item, pos, head = h[by], item[by], pos[by], head[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (pos[1:] != pos[:-1]) | (head[1:] != head[:-1])
            self.by_form[form] = (h[new], item[new], pos[new])

    def having(self, number: int, values: dict[int, str]) -> int | None:
        """The first item of a class that has these values in these slots."""
        slots = self.members.get(number)
        if slots is None:
            return number if all(self.items[number].values[j] == v for j, v in values.items()) else None
        left: set[int] | None = None
        for own in sorted((slots.get((j, v), set()) for j, v in values.items()), key=len):
            left = own if left is None else left & own
            if not left:
                return None
        return number if left is None else min(left)

    def __bool__(self) -> bool:
        return bool(self.by_form)


def _chains(hits: list[tuple[int, int]], drift: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of hits (window in item, token in document) in order: each diagonal, and the longest over several ones.

    The second kind ends at the last hit of each diagonal; its steps go from
    diagonal to diagonal by ``drift`` at most.
    """
    ends: dict[int, list[tuple[int, int, int, tuple | None]]] = {}
    begins: dict[int, list[int]] = {}
    lines: list[int] = []
    for pos, token in sorted(hits):
        shift, best = token - pos, None
        for near in lines[bisect_left(lines, shift - drift) : bisect_right(lines, shift + drift)]:
            # the longest of a diagonal is the last in front of both
            k = bisect_left(begins[near], min(pos, token - near)) - 1
            if k >= 0 and (best is None or ends[near][k][0] > best[0] or (ends[near][k][0] == best[0] and near == shift)):
                best = ends[near][k]
        if shift not in ends:
            insort(lines, shift)
            ends[shift], begins[shift] = [], []
        ends[shift].append((1 if best is None else best[0] + 1, pos, token, best))
        begins[shift].append(pos)
    for line in ends.values():
        own = [(pos, token) for _, pos, token, _ in line]
        yield own
        chain, end = [], line[-1]
        while end is not None:
            chain.append((end[1], end[2]))
            end = end[3]
        if chain[::-1] != own:
            yield chain[::-1]


def _same_slots(kind: list[int], item_values: list[str], doc_values: list[str]) -> tuple[int, int, int]:
    """Slots, slots whose value changed, and slots that contradict the commonest reading of their value."""
    seen: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
    slots = changed = 0
    for k, a, b in zip(kind, item_values, doc_values, strict=True):
        if k:
            slots += 1
            changed += a != b
            seen[int(k), a][b] += 1
    against = sum(sum(v.values()) - max(v.values()) for v in seen.values())
    return slots, changed, against


def _scan(table: WindowTable, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(t: Template, item: Item, windows: list[tuple[int, int, int]]) -> dict[int, tuple[int, str, str]]:
        """By slot: kind, the item's value and the document's under ``windows`` (form, window in item, token in chunk)."""
        slots: dict[int, tuple[int, str, str]] = {}
        for form, pos, token in sorted(windows):
            for k in range(item.widths[form]):
                j = pos + k
                own = j if form == 0 else int(item.run[j])
                kind = int(item.kind[own])
                if not kind or own in slots:
                    continue
                # names are words in form 1, where they are equal
                value = item.values[own] if form == 0 or kind == NAME else item.plain[j]
                slots[own] = (kind, value, value if form == 1 and kind == NAME else t.text(token + k, form))
        return slots

    def judge(t: Template, hits: list[tuple[int, int, int, int]]):
        """hits: (item, form, window in item, first token in chunk) of one document."""
        by_item: dict[int, dict[tuple[int, int], list]] = defaultdict(lambda: defaultdict(list))
        for item, form, pos, token in hits:
            at = int(table.items[item].base[form][pos]), int(t.base[form][token])
            by_item[item][at].append((form, pos, token))
        best: dict[int, tuple] = {}
        for number, own in by_item.items():
            item, head, at = table.items[number], table.first[number], own
            if head != number and head in by_item:  # what all of the class have
                at = {place: own.get(place, []) + by_item[head].get(place, []) for place in {*own, *by_item[head]}}

            def share(places):
                return item.share([{p for p, q in places if any(w[0] == form for w in at[p, q])} for form in (0, 1)])

            if share(at) < coverage:
                continue
            for chain in _chains(list(at), item.drift):
                part = share(chain)
                if part < coverage:
                    continue
                under = aligned(t, item, [w for place in chain for w in at[place]])
                slots, changed, against = _same_slots(*(list(zip(*under.values(), strict=True)) or [(), (), ()]))
                if 4 * against > slots:  # values that do not follow from one another
                    continue
                said = number
                if changed and number == head and (exact := table.having(head, {j: v for j, (_, _, v) in under.items()})) is not None:
                    said, changed = exact, 0
                if item.short and changed:  # so few words say nothing without their values
                    continue
                found = (part, -changed, said, slots, changed, head)
                if said not in best or found[:2] > best[said][:2]:
                    best[said] = found
        # changed values are told once for a class, and not beside one of its items as it stands
        exact = {head for *_, changed, head in best.values() if not changed}
        return [b[:5] for b in best.values() if not b[4] or b[5] not in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("doc_id")
            for chunk in chunks(batch.column("text")):
                t = Template(chunk)
                by_doc: dict[int, list] = defaultdict(list)
                for (width, form), (h, item, pos) in table.by_form.items():
                    own = t.windows(width, form)
                    if not len(own):
                        continue
                    hit = np.flatnonzero(_isin(own, h))
                    hit = hit[t.docs[form][hit] == t.docs[form][hit + width - 1]]
                    left, right = np.searchsorted(h, own[hit], side="left"), np.searchsorted(h, own[hit], side="right")
                    for token, lo, hi in zip(hit.tolist(), left.tolist(), right.tolist(), strict=True):
                        whole = t.whole_sentence(form, token, width)
                        for j in range(lo, hi):
                            if table.items[int(item[j])].short and not whole:
                                continue
                            by_doc[int(t.docs[form][token])].append((int(item[j]), form, int(pos[j]), token))
                for doc, hits in by_doc.items():
                    rows += [(ids[chunk.first + doc].as_py(), table.ids[item], share, slots, changed) for share, _, item, slots, changed in judge(t, hits)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "slots", "slots_changed"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The benchmark items that documents contain, verbatim or with other values.

    One row per document and item, and where only values differ from all items
    of a template, one for the first of these: ``doc_id, item_id, coverage`` (share of the
    item's tokens under windows that line up in order), ``slots, slots_changed, kind`` (``verbatim`` or
    ``reparameterised``).  A document without a row is clean.

    The benchmark is read to the driver block by block, and each block is
    looked up by one scan of the texts, so a task holds about ``block_items``
    items and ``block_bytes`` bytes of them.  An item of fewer than SHORTEST words is
    found where it is a whole sentence with the same values; items without a
    word are in no document.  Null and empty texts contain nothing.  Repeated rows are reported once
    per id.  A null id is reported as null.  Other columns are not read; an
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    schema = "doc_id long, item_id long, coverage double, slots long, slots_changed long"
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n, out = size["n"], None
    blocks = max(1, -(-n // block_items), -(-size["bytes"] // block_bytes))
    for b in range(blocks if n else 0):
        # a hash block may be larger than the mean, which the limits leave room for
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).orderBy("item_id").collect()
        table = WindowTable([r["item_id"] for r in rows], [r["text"] for r in rows])
        if table:
            found = texts.mapInArrow(_scan(table, coverage), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (-F.col("slots_changed")).alias("same"), "slots", "slots_changed")).alias("best"))
    kind = F.when(F.col("slots_changed") > 0, "reparameterised").otherwise("verbatim")
    return best.select("doc_id", "item_id", "best.coverage", "best.slots", "best.slots_changed").withColumn("kind", kind)
