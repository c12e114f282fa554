"""N-gram Jaccard join with several global token orders.

Every document is the set of its distinct word shingles.  Two sets of Jaccard
similarity t or more share a token among the first ``n - ceil(t n) + 1`` tokens
under *any* global order of the tokens.  One order generates candidates in a
shuffle of prefix tokens; a candidate must also share a token in its prefixes
under each of the other orders.  Only pairs that pass the intersection of all
filters are verified on the full sets, which are shipped for them alone.

All orders put tokens that are frequent somewhere last, so boilerplate leaves
the prefixes; within a frequency class each order permutes tokens by its own
hash.  Any order gives the same links, so the frequencies may be approximate.

A parity sketch of each set, a few words of bits, bounds the size of the
difference of two sets from below; it drops pairs whose shared boilerplate
passes every prefix.

Equal sets collapse to one representative first.  Candidates come in two
rounds: each member of a token's bucket with the one before it and with the
first one, and after these links have merged documents into components, all
pairs of a bucket that are still in different components.  A large group of
near copies therefore costs its size, not its square, and no link that would
join two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch, most_frequent
from docengine.llm.components import connected_components
from docengine.llm.textnp import chunks, shingles, splitmix, words

_U = np.uint64

#: Most entries of the frequency table that is sent to the executors (16 bytes each).
FREQUENT = 200_000

#: Bucket rows from which a token's bucket is dealt over SALTS tasks; COLD is the salt of all other buckets.
HOT_ROWS, SALTS, COLD = 50_000, 32, -1

#: Rows of a bucket on one side of the second round's join that one task takes; groups above this share of all rows are salted.
OPEN_ROWS, HOT_SHARE = 2_000, 0.001

#: Bits of the largest id filter that is sent to the executors (16 MB).
MAX_BITS = 1 << 27

#: Tokens that are counted together before rare ones are dropped.
COUNT_BLOCK = 4_000_000

_SETS = "doc_id long, n long, sig1 long, sig2 long, rare long, prefix array<long>, second array<int>, third array<int>"
_TOKENS = "doc long, tokens array<long>"
#: 64-bit words of the parity sketch by which buckets are joined.
SKETCH = 8

_FIRST = "doc_id long, n long, sig1 long, sig2 long, sketch array<long>, wide array<long>, token long, rows long"


def _need(n: np.ndarray) -> np.ndarray:
    """Prefix length at similarity 0.8: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def _signatures(token: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two sums over each document's tokens that tell different sets apart."""
    begin, out = np.concatenate(([0], np.cumsum(n))), []
    for salt in (0x51, 0x52):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(splitmix(token ^ splitmix(np.array([salt], _U))))))
        out.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
    return out


def _parity_sketch(token: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """For each document, the parity of its tokens in each of 64 * ``size`` hash bins, as words of 64 bits.

    A token that only one of two sets has flips one bit, so the sketches differ
    in at most as many bits as the sets in tokens.  The two halves of a sketch,
    one over the other, are the sketch of half its size.
    """
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(offsets[-1], _U)
    bin_ = splitmix(token + _U(0x77))
    word = np.repeat(offsets[:-1], n) + ((bin_ >> _U(6)) % np.repeat(size, n).astype(_U)).astype(np.int64)
    np.bitwise_xor.at(out, word, _U(1) << (bin_ & _U(63)))
    return _lists(out, offsets)


def _sketch_size(n: np.ndarray) -> np.ndarray:
    """Words of a sketch with two bits or more for each token: SKETCH, doubled as often as it takes."""
    times = np.ceil(np.log2(np.maximum(2 * n, 64 * SKETCH) / (64 * SKETCH))).astype(np.int64)
    return SKETCH << times


def _first_pass(width: int, at_least: int = 4) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Size and signature of each document; and, as rows with a token, how many documents have it.

    Tokens are counted in blocks of COUNT_BLOCK; those rarer than ``at_least``
    in their block are not frequent anywhere that matters and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def row(ids, n, sigs, sketches, token, rows):
            return pa.RecordBatch.from_arrays([ids, n, *sigs, *sketches, token, rows], names=["doc_id", "n", "sig1", "sig2", "sketch", "wide", "token", "rows"])

        def flush():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= at_least
            none, no_list = (pa.nulls(int(keep.sum()), kind) for kind in (pa.int64(), pa.list_(pa.int64())))
            return row(none, none, (none, none), (no_list, no_list), pa.array(token[keep].view(np.int64)), pa.array(count[keep]))

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, _, doc, word = words(chunk)
                token, _, n = shingles(word, doc, chunk.n_docs, width)
                none = pa.nulls(chunk.n_docs, pa.int64())
                ids = batch.column("doc_id")[chunk.first : chunk.first + chunk.n_docs]
                sketches = [_parity_sketch(token, n, size) for size in (np.full_like(n, SKETCH), _sketch_size(n))]
                yield row(ids, pa.array(n), [pa.array(x) for x in _signatures(token, n)], sketches, none, none)
                held.append(token)
                total += len(token)
                if total >= COUNT_BLOCK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


class Orders:
    """The global token orders: frequency class first, then a hash of the order's own."""

    def __init__(self, tokens: np.ndarray, rows: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.rows = tokens[by], rows[by]
        self.kind = (np.log2(np.maximum(self.rows, 1)).astype(np.int64) + 1).astype(_U)

    def frequency(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, rows = np.zeros(len(token), _U), np.zeros(len(token), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
            hit = self.tokens[at] == token
            kind[hit], rows[hit] = self.kind[at[hit]], self.rows[at[hit]]
        return kind, rows

    @staticmethod
    def rank(token: np.ndarray, kind: np.ndarray, order: int) -> np.ndarray:
        return (kind << _U(56)) | (splitmix(token ^ splitmix(np.array([order], _U))) >> _U(8))

    def prefixes(self, token: np.ndarray, doc: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix tokens in order, their bucket sizes, offsets by document, and prefix lengths."""
        kind, rows = self.frequency(token)
        by = np.lexsort((self.rank(token, kind, order), doc))
        at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        size = np.where(n > 0, _need(n), 0)
        by = by[at < np.repeat(size, n)]
        return token[by], rows[by], np.concatenate(([0], np.cumsum(size))), size


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(width: int, orders: Orders) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Size, signature and prefixes of each document: of the first order its tokens, of the others 32 bits of each.

    Two different tokens of equal bits let a candidate pass a filter and never
    stop one.
    """

    def filter_list(token, doc, n, order):
        prefix, _, offsets, _ = orders.prefixes(token, doc, n, order)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((splitmix(prefix) >> _U(32)).astype(np.uint32).view(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, _, wdoc, word = words(chunk)
                token, doc, n = shingles(word, wdoc, chunk.n_docs, width)
                sums = _signatures(token, n)
                prefix, _, offsets, _ = orders.prefixes(token, doc, n, 1)
                rare = np.bincount(doc[orders.frequency(token)[1] == 0], minlength=chunk.n_docs)
                ids = batch.column("doc_id")[chunk.first : chunk.first + chunk.n_docs]
                cols = [ids, pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(rare), _lists(prefix, offsets), *[filter_list(token, doc, n, order) for order in (2, 3)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "sig1", "sig2", "rare", "prefix", "second", "third"])

    return run


def _tokens(width: int, wanted: np.ndarray, n_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The full sets of the documents whose id hits the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7)).astype(np.uint8) & 1 == 1))
            for chunk in chunks(batch.column("text")):
                _, _, wdoc, word = words(chunk)
                token, _, n = shingles(word, wdoc, chunk.n_docs, width)
                ids = batch.column("doc_id")[chunk.first : chunk.first + chunk.n_docs]
                yield pa.RecordBatch.from_arrays([ids, _lists(token, np.concatenate(([0], np.cumsum(n))))], names=["doc", "tokens"])

    return run


def _bucket_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop tokens with one row; name for each row the one before it and the bucket's first.

    Rows come sorted by token and salt.  A row is kept if a neighbour has the
    same token, so one row is carried from batch to batch.  A row of a salted
    token is always kept: its neighbours may all have other salts.
    """
    names = ["token", "salt", "doc", "n", "pos"]
    carry, first = None, None  # the last row, not yet decided; the first row of its bucket

    def candidates(x, other):
        """``other`` where the sizes and positions allow similarity 0.8, else null."""
        small, large = np.minimum(x[:, 3], other[:, 3]), np.maximum(x[:, 3], other[:, 3])
        most = 1 + np.minimum(x[:, 3] - 1 - x[:, 4], other[:, 3] - 1 - other[:, 4])
        fits = (5 * small >= 4 * large) & (9 * most >= 4 * (x[:, 3] + other[:, 3])) & (x[:, 2] != other[:, 2])
        return np.ma.array(other[:, 2], mask=~fits)

    def out(rows, prev, lead):
        cols = [pa.array(rows[:, i]) for i in range(5)] + [pa.array(x.data, mask=np.ma.getmaskarray(x)) for x in (prev, lead)]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "prev", "lead"])

    def decide(rows, before, start):
        """``rows`` but its last one, which may go on; ``before``: the row in front; ``start``: its bucket's first."""
        same = (rows[1:, :2] == rows[:-1, :2]).all(1)
        joins = np.concatenate(([before is not None and (before[:2] == rows[0, :2]).all()], same))
        heads = np.where(joins, -1, np.arange(len(rows)))
        heads = np.maximum.accumulate(heads)
        lead_rows = rows[np.maximum(heads, 0)]
        if start is not None:
            lead_rows = np.where((heads < 0)[:, None], start[None, :], lead_rows)
        prev_rows = np.concatenate((rows[:1] if before is None else before[None, :], rows[:-1]))
        prev, lead = candidates(rows, prev_rows), candidates(rows, lead_rows)
        prev[~joins] = lead[~joins] = np.ma.masked
        keep = joins | (rows[:, 1] != COLD)
        keep[:-1] |= same
        return keep, prev, lead, lead_rows

    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
        if carry is not None:
            rows = np.concatenate((carry[None, :], rows))
        keep, prev, lead, lead_rows = decide(rows, before, first)
        body = keep[:-1]
        if body.any():
            yield out(rows[:-1][body], prev[:-1][body], lead[:-1][body])
        carry = rows[-1]
        if len(rows) > 1:
            before = rows[-2]
        # the bucket's first row as seen from the carried row
        first = lead_rows[-2] if len(rows) > 1 else first
    if carry is not None:
        keep, prev, lead, _ = decide(carry[None, :], before, first)
        if keep[0]:
            yield out(carry[None, :], prev, lead)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough in full."""

    def sets(batch, name):
        """Tokens, pair of each token, and sizes; a list column may be a slice of a larger one."""
        col = batch.column(name)
        offsets = col.offsets.to_numpy().astype(np.int64)
        n = np.diff(offsets)
        return col.values.to_numpy()[offsets[0] : offsets[-1]].view(_U), np.repeat(np.arange(len(n)), n), n

    for whole in batches:
        for lo in range(0, whole.num_rows, 2_000):
            batch = whole.slice(lo, 2_000)
            x, xp, nx = sets(batch, "a_tokens")
            y, yp, ny = sets(batch, "b_tokens")
            token, pair = np.concatenate((x, y)), np.concatenate((xp, yp))
            by = np.lexsort((token, pair))
            token, pair = token[by], pair[by]
            both = np.bincount(pair[1:][(token[1:] == token[:-1]) & (pair[1:] == pair[:-1])], minlength=batch.num_rows)
            hit = pa.array(100 * both >= 80 * (nx + ny - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(hit), batch.column("b").filter(hit)], names=["a", "b"])


def _id_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of the hashed ids, of 16 bits for each but at most MAX_BITS.

    It may let other ids pass, never lose one; the joins after it are exact.
    """
    n_bits = 1 << min(MAX_BITS.bit_length() - 1, max(15, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(column), F.lit(n_bits))
    maps = ids.groupBy((bit / 32768).cast("long").alias("block")).agg(F.bitmap_construct_agg((bit % 32768)).alias("bits")).collect()
    wanted = np.zeros(n_bits // 8, np.uint8)
    for row in maps:  # 4 kB each, and n_bits / 32768 of them at most
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        wanted[row["block"] * 4096 : row["block"] * 4096 + len(own)] |= own
    return wanted, n_bits


def _links(pairs: DataFrame, texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Those of the saved pairs that are links."""
    wanted, n_bits = _id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    keyed = texts.where("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits)))
    sets = scratch.save(keyed.mapInArrow(_tokens(width, wanted, n_bits), _TOKENS), "tokens")
    side = lambda s: sets.select(F.col("doc").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    links = scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long").distinct(), "links")
    scratch.drop(sets)
    return links


def _agreed(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that share a token in their prefixes under each of the other orders."""
    side = lambda s: reps.select(F.col("doc").alias(s), F.col("second").alias(f"{s}2"), F.col("third").alias(f"{s}3"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose wide sketches allow similarity 0.8: their sets differ in at most a ninth of their sizes' sum.

    The wider of two sketches is halved to the other's size; sizes that allow
    the similarity are at most one doubling apart.
    """
    x = pairs.join(sketches.toDF("a", "xn", "xs"), "a").join(sketches.toDF("b", "yn", "ys"), "b")
    size = F.least(F.size("xs"), F.size("ys"))

    def word(sketch: str, i: Column) -> Column:
        return F.get(sketch, i).bitwiseXOR(F.when(F.size(sketch) > size, F.get(sketch, i + size)).otherwise(F.lit(0).cast("long")))

    differ = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda bits, i: bits + F.bit_count(word("xs", i).bitwiseXOR(word("ys", i))))
    return x.where(F.expr("5 * xn >= 4 * yn and 5 * yn >= 4 * xn")).where(9 * differ <= F.col("xn") + F.col("yn")).select("a", "b")


def _dealt(tokens: DataFrame, orders: Orders, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The prefix tokens with the salt of their bucket, and the scratch tables they are read from.

    Only tokens that HOT_ROWS representatives hold are salted.  The row that
    leads such a bucket is passed to every salt, so each row meets it.
    """
    tokens = tokens.select("token", "rare", "doc", "n", F.col("pos").cast("long").alias("pos"))
    cold = F.lit(COLD).cast("long").alias("salt")
    often = orders.tokens[orders.rows >= HOT_ROWS].view(np.int64).tolist()
    if not often:
        return tokens.select("token", cold, "rare", "doc", "n", "pos"), []
    spark = tokens.sparkSession
    tokens = scratch.save(tokens, "prefixes")
    some = tokens.join(F.broadcast(spark.createDataFrame([(t,) for t in often], "token long")), "token", "left_semi")
    hot = some.groupBy("token").agg(F.count("*").alias("rows"), F.min(F.struct("rare", "n", "doc", "pos")).alias("lead")).where(F.col("rows") >= max(HOT_ROWS, 2))
    hot = scratch.save(hot, "hot")
    own = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("long")
    dealt = tokens.join(F.broadcast(hot.select("token", "rows")), "token", "left").select("token", F.when(F.col("rows").isNull(), cold).otherwise(own).alias("salt"), "rare", "doc", "n", "pos")
    leads = hot.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "lead.rare", "lead.doc", "lead.n", "lead.pos")
    return dealt.unionByName(leads.where(F.col("salt") != own)), [tokens, hot]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Components of the documents whose shingle sets are at least 0.8 similar.

    A document's set holds the distinct ``width``-word shingles of its whole
    text with A-Z lower-cased; with fewer words, its whole sequence is the one
    shingle; without words (or with a null text) the set is empty and linked
    with nothing.  Returns one row per input row: ``doc_id, n_shingles,
    component_id`` (the smallest id reachable by links, its own included).

    Repeated rows are equal sets, hence one component.  Rows that share an id
    are one document: each row has its own size, and what is like one of them is
    in the component of all.  A row with a null id gets the component of its
    equals, or null.  Other columns are not read; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.limit(1).count():
        return _join_unique(texts, width, scratch)
    # Rows have numbers of their own while they are compared; ids unite them afterwards.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))
    placed = scratch.save(placed, "rows")
    found = _join_unique(placed.select(F.col("row").alias("doc_id"), "text"), width, scratch).withColumnRenamed("doc_id", "row")
    found = scratch.save(found.join(placed.where("row is not null").select("row", "doc_id"), "row", "left").select("doc_id", "n_shingles", F.col("component_id").alias("own")), "found")
    least = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("z")).where("a < z").select("doc_id", "a")
    edges = found.join(least, "doc_id").where("own <> a").select("a", F.col("own").alias("b")).distinct()
    united = connected_components(edges, scratch).select(F.col("id").alias("own"), "label")
    groups = found.where("own is not null").groupBy("own").agg(F.min("doc_id").alias("smallest")).join(united, "own", "left").withColumn("label", F.coalesce("label", "own"))
    smallest = groups.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = groups.select("own", "label").join(smallest, "label").select("own", "component_id")
    return found.join(named, "own", "left").select("doc_id", "n_shingles", "component_id")


def _join_unique(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The join of ``doc_id, text`` whose ids, but for nulls, are different."""
    spark = texts.sparkSession
    passed = scratch.save(texts.mapInArrow(_first_pass(width), _FIRST), "first")
    counted = passed.where("token is not null").groupBy("token").agg(F.sum("rows").alias("rows"))
    frequent = most_frequent(counted, "token", "rows", FREQUENT)
    orders = Orders(frequent["token"].to_numpy(np.int64).view(_U), frequent["rows"].to_numpy(np.int64))
    sets = passed.where("token is null").select("doc_id", "n", "sig1", "sig2")
    some = sets.where("n > 0 and doc_id is not null")

    # One representative of each set goes on, with its prefix.
    prefixes = texts.where("doc_id is not null").mapInArrow(_sets(width, orders), _SETS).where("n > 0")
    reps = prefixes.groupBy("n", "sig1", "sig2").agg(F.min(F.struct("doc_id", "rare", "prefix", "second", "third")).alias("rep"))
    reps = scratch.save(reps.select(F.col("rep.doc_id").alias("doc"), "n", "rep.rare", "rep.prefix", "rep.second", "rep.third"), "reps")
    tokens, held = _dealt(reps.select("doc", "n", "rare", F.posexplode("prefix").alias("pos", "token")), orders, scratch)
    # The document with the fewest tokens of its own leads a bucket: of a group of edited copies, the one nearest to all.
    buckets = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "rare", "n", "doc").drop("rare")
    shared = buckets.mapInArrow(_bucket_neighbours, "token long, salt long, doc long, n long, pos long, prev long, lead long")
    # without the leads' copies in other salts than their own, which are in `shared` once already
    shared = scratch.save(shared.where((F.col("salt") == COLD) | (F.col("salt") == F.pmod(F.xxhash64("doc"), F.lit(SALTS)))), "shared")
    scratch.drop(*held)

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = shared.select("doc", F.explode(F.array("prev", "lead")).alias("other")).where("other is not null").select(*pair(F.col("doc"), F.col("other"))).distinct()
    sketches = passed.where("token is null and n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "sketch", "wide")).alias("s"))
    wide = sketches.select("doc_id", "s.n", "s.wide")
    near = scratch.save(_alike(_agreed(near, reps), wide), "near")
    first = _links(near, texts, width, scratch)
    merged = connected_components(first, scratch)

    # All pairs of a bucket that are still apart; buckets of one component are done.
    at = shared.select("token", "doc", "n", "pos").join(merged.select(F.col("id").alias("doc"), "label"), "doc", "left")
    at = apart_rows = scratch.save(at.select("token", "doc", "n", "pos", F.coalesce("label", "doc").alias("comp")), "apart")
    # A bucket of many rows is dealt over several tasks: one side is split, the other repeated in each.
    salts = F.ceil(F.count("*") / OPEN_ROWS).cast("int")
    open_ = at.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), salts.alias("salts")).where("x < y").select("token", "salts")
    at = at.join(open_, "token").join(sketches.select("doc_id", F.col("s.sketch").alias("s")), F.col("doc") == F.col("doc_id"))
    at = at.select("token", "salts", "doc", "n", "pos", "comp", *[F.col("s")[k].alias(f"s{k}") for k in range(SKETCH)])
    x = at.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).alias("x")
    y = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    most = 1 + F.least(F.expr("x.n - 1 - x.pos"), F.expr("y.n - 1 - y.pos"))
    differ = F.expr(" + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(SKETCH)))
    fits = F.expr("x.token = y.token and x.salt = y.salt and x.comp < y.comp and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n") & (9 * most >= 4 * F.expr("x.n + y.n"))
    # at similarity 0.8 the sets differ in at most a ninth of their sizes' sum
    fits = fits & (9 * differ <= F.expr("x.n + y.n"))
    apart = x.join(y, fits).select(*pair(F.col("x.doc"), F.col("y.doc"))).distinct()
    second = _links(scratch.save(_alike(_agreed(apart.join(near, ["a", "b"], "left_anti"), reps), wide), "pairs"), texts, width, scratch)

    comps = connected_components(first.unionByName(second), scratch)
    scratch.drop(shared, apart_rows, reps, near)
    # Groups of copies above HOT_SHARE of all rows, fewer than its reciprocal, are dealt over SALTS tasks.
    least = HOT_SHARE * sets.count()
    key = ["n", "sig1", "sig2"]
    groups = some.groupBy(*key).agg(F.min("doc_id").alias("rep"), (F.count("*") > least).alias("hot"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    dealt = sets.join(F.broadcast(groups.where("hot").select(*key, "hot")), key, "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    found = groups.join(comps, F.col("rep") == F.col("id"), "left")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.select(*key, F.coalesce("label", "rep").alias("component"), F.explode(every).alias("salt"))
    out = dealt.join(found, [*key, "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
