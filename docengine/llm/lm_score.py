"""Language-model scoring with a hashed maximum-entropy model.

Every token belongs to a cell and every cell to a class.  The most frequent
tokens have a cell each; all other tokens, unseen ones too, are dealt to cells
by hash, within which they follow their counts.  The model predicts the class,
then the cell within the class; both are softmaxes over hashed features of the
context: the previous word, the word before it (a skip), and the two together.

Weights are fitted by distributed gradient updates.  In step t the training
documents whose hashed id falls to t are read with fixed weights, and the
features' observed and expected counts, whose difference is the gradient, are
summed over all tasks before any weight moves.  Each token adds its own outcome
to the observed counts and one drawn from the model to the expected ones; both
are whole numbers, so the result does not depend on how rows are dealt to tasks
or batches.  Over the steps every training document
is used once.  The hash rows grow with the square root of the counted tokens,
and so does the number of partial sums.  Token counts grow with the corpus and
stay distributed: counts of the most frequent tokens, a bounded number, go to
every task, and those of all other tokens are joined to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch, most_frequent, release, shuffles_freed
from docengine.llm.textnp import chunks, splitmix, words

_U = np.uint64
_NO_WORD = splitmix(np.array([0x5EED], _U))[0]

#: Bound of a weight.
MOST_WEIGHT = 9.0

#: The token that ends every document.
END = splitmix(np.array([0xE0D], _U))[0]


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training.

    ``classes * cells`` cells, of which the last ``rare_classes * cells`` are
    dealt by hash.  The hash rows are the power of two nearest to the square root
    of the training tokens, between ``least_rows`` and ``most_rows``; at the most,
    each task holds two tables of 50 MB.
    """

    classes: int = 96
    cells: int = 96
    rare_classes: int = 24
    least_rows: int = 1 << 12
    most_rows: int = 1 << 17
    frequent: int = 200_000
    steps: int = 6
    batch: int = 4_096
    rate: float = 0.4
    damp: float = 8.0
    slices: int = 128
    tokens_per_partial: int = 100_000

    @property
    def own(self) -> int:
        """Tokens with a cell of their own."""
        return (self.classes - self.rare_classes) * self.cells

    def rows(self, tokens: int) -> int:
        return min(self.most_rows, max(self.least_rows, 1 << round(np.log2(max(tokens, 1)) / 2)))

    def partials(self, tokens: int) -> int:
        """Tasks of a step, each of which sends one partial sum."""
        return max(8, round((tokens / self.tokens_per_partial) ** 0.5))


def fold(doc_id: Column) -> Column:
    """Fold 0..4 of a document; fold 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


class Stream:
    """The tokens of a chunk in order, each document closed by the end token."""

    def __init__(self, chunk):
        _, _, doc, word = words(chunk)
        n = len(word)
        counts = np.bincount(doc, minlength=chunk.n_docs) if n else np.zeros(chunk.n_docs, np.int64)
        at = np.arange(n) + doc  # every earlier document has put one end token in front
        self.token = np.empty(n + chunk.n_docs, _U)
        self.token[at] = word
        self.doc = np.repeat(np.arange(chunk.n_docs), counts + 1)
        self.size = counts + 1
        ends = np.cumsum(self.size) - 1
        self.token[ends] = END
        first = np.zeros(len(self.token), bool)
        first[ends[:-1] + 1] = True
        if len(first):
            first[0] = True
        self.before = np.concatenate(([_NO_WORD], self.token[:-1]))
        self.before[first] = _NO_WORD
        second = np.concatenate(([False], first[:-1]))
        self.skip = np.concatenate(([_NO_WORD], self.before[:-1]))
        self.skip[first | second] = _NO_WORD
        self.ends = ends

    def draws(self, ids: np.ndarray) -> np.ndarray:
        """Random bits of each token, by document id and place."""
        place = np.arange(len(self.token)) - np.repeat(self.ends - self.size + 1, self.size)
        return splitmix(np.repeat(splitmix(ids + _U(0xD1CE)), self.size) + place.astype(_U))


class Model:
    """Cells, hashed weights and the counts behind the cells."""

    def __init__(self, s: Settings, token: np.ndarray, count: np.ndarray, total: int, distinct: int, rare_total: np.ndarray, rare_distinct: np.ndarray):
        """``token, count``: the frequent tokens, most frequent first; ``rare_*``: sums over each cell that is dealt by hash."""
        self.s, self.total, self.distinct = s, total, distinct
        by = np.argsort(token)
        self.token, self.count = token[by], count[by]
        place = np.arange(len(token))
        place[s.own :] = -1
        # Neighbours in frequency share a class, so classes differ in frequency.
        self.place = place[by]
        self.rare_mass = rare_total + 0.5 * (rare_distinct + 1)
        mass = np.full(s.classes * s.cells, 1e-6)
        known = min(s.own, len(token))
        mass[:known] = count[:known]
        mass[s.own :] = self.rare_mass
        mass = mass.reshape(s.classes, s.cells)
        self.class_bias = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        self.cell_bias = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.n_rows = s.rows(total)
        self.by_class = np.zeros((self.n_rows, s.classes), np.float32)
        self.by_cell = np.zeros((self.n_rows, s.cells), np.float32)

    def look_up(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each token and its count (0: not frequent)."""
        s = self.s
        rare = (s.own + (token >> _U(20)) % _U(s.rare_classes * s.cells)).astype(np.int64)
        if not len(self.token):
            return rare, np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        hit = self.token[at] == token
        own = np.where(hit, self.place[at], -1)
        return np.where(own >= 0, own, rare), np.where(hit, self.count[at], 0)

    @staticmethod
    def contexts(stream: Stream) -> np.ndarray:
        """Three feature hashes per token, one row for each feature."""
        b, k = stream.before, stream.skip
        return np.stack((splitmix(b + _U(1)), splitmix(k + _U(2)), splitmix(b * _U(3) + splitmix(k + _U(4)))))

    @staticmethod
    def _softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all outcomes and the natural log of the target's; weights are bounded, so no exponent overflows."""
        p = weights[rows[0]]
        own = np.empty_like(p)
        for feature in rows[1:]:
            p += np.take(weights, feature, axis=0, out=own, mode="clip")
        p += bias
        said = p[np.arange(len(target)), target]
        np.exp(p, out=p)
        sums = p @ np.ones(p.shape[1], np.float32)
        p /= sums[:, None]
        return p, said - np.log(sums)

    def _levels(self, context: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Weights, hash rows, bias and target of the two softmaxes."""
        s, n = self.s, _U(self.n_rows)
        cls, inside = cell // s.cells, cell % s.cells
        yield self.by_class, (context % n).astype(np.int64), self.class_bias, cls
        own = splitmix(context + cls.astype(_U) * _U(0x9E3779B97F4A7C15))
        yield self.by_cell, (own % n).astype(np.int64), self.cell_bias[cls], inside

    def log_p(self, context: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(cell in class) of each token."""
        out = np.zeros(len(cell))
        for lo in range(0, len(cell), self.s.batch):
            part = slice(lo, lo + self.s.batch)
            for level in self._levels(context[:, part], cell[part]):
                out[part] += self._softmax(*level)[1]
        return out

    def add_counts(self, context: np.ndarray, cell: np.ndarray, draw: np.ndarray, sums: list[np.ndarray]) -> None:
        """Adds each feature's observed and expected counts to ``sums``: observed, expected of the classes, then of the cells.

        The expected counts of a token are one outcome drawn from the model at
        its context, at random bits ``draw`` that do not depend on the token:
        over many tokens their sum is the expectation.
        """
        one = np.int32(1)
        for lo in range(0, len(cell), self.s.batch):
            part = slice(lo, lo + self.s.batch)
            for i, (weights, rows, bias, target) in enumerate(self._levels(context[:, part], cell[part])):
                p, _ = self._softmax(weights, rows, bias, target)
                at = (splitmix(draw[part] + _U(i)) >> _U(40)).astype(np.float32) / np.float32(1 << 24)
                np.cumsum(p, axis=1, out=p)
                p[:, -1] = 2
                drawn = np.argmax(p >= at[:, None], axis=1)
                for own in rows:
                    np.add.at(sums[2 * i].reshape(-1), own * p.shape[1] + target, one)
                    np.add.at(sums[2 * i + 1].reshape(-1), own * p.shape[1] + drawn, one)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens of training documents, collapsed per two million tokens."""
    held, n = [], 0

    def flush():
        token, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "n"])

    for batch in batches:
        for chunk in chunks(batch.column("text")):
            token = Stream(chunk).token
            held.append(token)
            n += len(token)
            if n >= 2_000_000:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _counts_of_features(shipped, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The observed and expected counts of a task's documents, in slices; ``shipped`` is the broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        sums = [np.zeros(w.shape, np.int32) for w in (model.by_class, model.by_class, model.by_cell, model.by_cell)]
        seen = False
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                stream = Stream(chunk)
                own = ids[chunk.first : chunk.first + chunk.n_docs].view(_U)
                model.add_counts(model.contexts(stream), model.look_up(stream.token)[0], stream.draws(own), sums)
                seen = True
        if seen:
            parts = zip(*[np.array_split(x.reshape(-1), s.slices) for x in sums], strict=True)
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([x.tobytes()], pa.binary()) for x in part]], names=["slice", "o1", "e1", "o2", "e2"])

    return run


def _move(s: Settings) -> Callable[[tuple[pa.Scalar, ...], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The gradient step of one slice of the weights, from the partial sums read batch by batch.

    A weight moves along its gradient, observed minus expected count, over the
    logarithmic mean of the two, both damped: by the logarithm of their ratio.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                own = [np.frombuffer(batch.column(c)[row].as_buffer(), np.int32).astype(np.int64) for c in ("o1", "e1", "o2", "e2")]
                total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
        assert total is not None
        steps = [s.rate * np.log((total[i] + s.damp) / (total[i + 1] + s.damp)) for i in (0, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *[pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in steps]], names=["slice", "by_class", "by_cell"])

    return run


def _score(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: sizes, sums over frequent tokens, and its other tokens with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        own_cells = model.s.own
        scale = np.log10(model.total + 0.5 * (model.distinct + 1))
        rare_scale = np.log10(model.rare_mass)
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                stream = Stream(chunk)
                n_docs = chunk.n_docs
                cell, count = model.look_up(stream.token)
                log_p = model.log_p(model.contexts(stream), cell) / np.log(10)
                frequent, rare = count > 0, cell >= own_cells
                log_c = np.where(frequent, np.log10(count + 0.5), 0.0)
                # base: every token pays the scale; tokens that are not frequent add their count's part later
                base = np.bincount(stream.doc, log_c, n_docs) - scale * stream.size
                log_p[rare] += log_c[rare] - rare_scale[cell[rare] - own_cells]
                score = np.bincount(stream.doc, log_p, n_docs)
                known = np.bincount(stream.doc, frequent, n_docs).astype(np.int64)
                token, doc = stream.token[~frequent], stream.doc[~frequent]
                by = np.lexsort((token, doc))
                token, doc = token[by], doc[by]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(token)))
                token, doc = token[start], doc[start]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs)))) if len(doc) else np.zeros(n_docs + 1, np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in (token.view(np.int64), times.astype(np.int64))]
                own = slice(chunk.first, chunk.first + n_docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[own]), batch.column("doc_id")[own], batch.column("held_out")[own], pa.array(stream.size.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), *lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tokens", "times"],
                )

    return run


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tokens array<long>, times array<long>"


def _row_block(s: Settings) -> Column:
    """The cell that is dealt to a token by hash, counted from the first such cell."""
    return F.pmod(F.shiftrightunsigned("token", 20), F.lit(s.rare_classes * s.cells))


def train_model(texts: DataFrame, counts: DataFrame, settings: Settings, weighed: bool = True) -> Model:
    """Fit the model to the training texts, whose token counts are given."""
    s, spark = settings, texts.sparkSession
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    top = most_frequent(counts, "token", "n", s.frequent)
    token, count = top["token"].to_numpy(np.int64).view(_U), top["n"].to_numpy(np.int64)
    # Sums over the cells that are dealt by hash, less the tokens that have a cell of their own.
    n_rare = s.rare_classes * s.cells
    rare_total, rare_distinct = np.zeros(n_rare), np.zeros(n_rare)
    for r in counts.groupBy(_row_block(s).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():  # at most n_rare rows
        rare_total[r["cell"]], rare_distinct[r["cell"]] = r["n"], r["d"]
    cell = ((token[: s.own] >> _U(20)) % _U(n_rare)).astype(np.int64)
    np.subtract.at(rare_total, cell, count[: s.own])
    np.subtract.at(rare_distinct, cell, 1)
    model = Model(s, token, count, int(sums["total"]), int(sums["distinct"]), rare_total, rare_distinct)
    for turn in range(s.steps if weighed else 0):
        share = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(s.steps)) == turn).select("doc_id", "text").coalesce(s.partials(model.total))
        shipped = spark.sparkContext.broadcast(model)
        moves = share.mapInArrow(_counts_of_features(shipped, s), "slice long, o1 binary, e1 binary, o2 binary, e2 binary")
        with shuffles_freed(spark):
            moves = moves.groupBy("slice").applyInArrow(_move(s), "slice long, by_class binary, by_cell binary").collect()  # the size of the weights
        shipped.destroy()
        for name in ("by_class", "by_cell") if moves else ():
            weights = getattr(model, name)
            weights += np.concatenate([np.frombuffer(bytes(r[name]), np.float32) for r in sorted(moves, key=lambda r: r["slice"])]).reshape(weights.shape)
            np.clip(weights, -MOST_WEIGHT, MOST_WEIGHT, out=weights)
        release(spark)
    return model


def lm_score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all documents under the model and under token counts.

    Tokens are the words of the whole text, A-Z lower-cased, and one end token.
    The documents whose ``crc32(id as text) mod 5`` is not 1 are learned from.
    Returns one row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    A null text is empty and has the end token alone.  A null id is an empty
    string to the fold.  Repeated rows count and are scored one by one; how rows
    are dealt to partitions changes no score beyond rounding.  Other
    columns are not read; an empty table gives an empty result.  Without any
    training document every token is unknown and base_score is 0.
    """
    s = settings
    scratch = Scratch(docs.sparkSession, "lm")
    held = fold(F.col(id_col)) == 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    training = texts.where("not held_out")
    counts = training.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    model = train_model(training, counts, s)

    scored = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), _SCORED)
    scored = scratch.save(scored, "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("row", "t.tokens", "t.times")
    found = rest.join(counts.select(F.col("token").alias("tokens"), "n"), "tokens", "left")
    c = F.coalesce("n", F.lit(0))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"))
    out = scored.drop("tokens", "times").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
