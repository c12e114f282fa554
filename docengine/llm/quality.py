"""Quality classifier by co-training two views of a document.

The content view sees the text: its words, their beginnings and its symbols as
hashed presence features, and layout statistics in bins.  The page view sees
metadata alone: language, source and stated length.  In each round both are
fitted, all unlabelled documents are scored by both, and each view's most
confident judgements go to the other one as pseudo-labels.  At the end both
are calibrated on labels that no round has fitted, combined, and all documents
are scored in one pass.

Fitting sums loss and gradient over the tasks that hold the labelled rows;
features of all other documents are made where their text is scanned and never
stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import Scratch, release
from docengine.llm.textnp import LOWER, SPACE, Chunk, chunks, span_hash, spans, splitmix

_U = np.uint64

#: Bytes of the word beginnings that are features besides the whole word.
STEMS = (5, 7)

#: Dimensions of the hashed features of each view.
CONTENT_DIMS, PAGE_DIMS = 1 << 17, 1 << 12

#: Bins of a share in the layout statistics.
BINS = 16

_DIGIT, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds of the training; scoring has none.

    ``labelled`` bounds the labelled rows used for fitting: those with the
    smallest seeded hash of their id.  ``exchanged`` bounds the pseudo-labels
    that a view hands over in a round, half of them good documents, out of all
    unlabelled ones.  ``share_kept`` is the share of good held-out documents
    that the threshold must keep.
    """

    labelled: int = 12_000
    rounds: int = 2
    confident: float = 0.97
    exchanged: int = 1_500
    steps: int = 25
    ridge: float = 0.001
    share_kept: float = 0.995
    seed: int = 11


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words: letters, and all beyond ASCII but the Latin-1 signs and general punctuation."""
    letter = _LETTER[data]
    for lead, size in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(data == lead)
        for k in range(size):
            letter[at[at + k < len(data)] + k] = False
    return letter


def _bins(share: np.ndarray) -> np.ndarray:
    return np.minimum((np.sqrt(np.maximum(share, 0)) * BINS).astype(np.int64), BINS - 1)


def content_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The features of each document of a chunk, distinct and in order, and how many each has."""
    data, n_docs = LOWER[chunk.data], chunk.n_docs
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[two] += 0x20
    letter, space = _letters(data), SPACE[data]
    start, end, doc = spans(letter, chunk)
    word = span_hash(data, start, end)
    hashes, docs = [word], [doc]
    for size in STEMS:
        longer = end - start > size
        hashes.append(splitmix(span_hash(data, start[longer], start[longer] + size) + _U(size)))
        docs.append(doc[longer])
    s_start, s_end, s_doc = spans(~letter & ~space, chunk)
    hashes.append(splitmix(span_hash(data, s_start, s_end) + _U(1)))
    docs.append(s_doc)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[chunk.doc_end] - total[chunk.doc_start]

    size = chunk.doc_end - chunk.doc_start
    n, n_words = np.maximum(size, 1), np.bincount(doc, minlength=n_docs)
    upper, digit, spaces, symbol = (per_doc(x) for x in (_UPPER[chunk.data], _DIGIT[data], space, ~letter & ~space & ~_DIGIT[data]))
    lines, pipes = per_doc(data == 0x0A), per_doc(data == 0x7C)
    seen = np.unique(doc * (1 << 32) + (word & _U(0xFFFFFFFF)).astype(np.int64)) >> 32 if len(doc) else doc
    distinct = np.bincount(seen, minlength=n_docs) / np.maximum(n_words, 1)
    log = lambda x: np.log2(1 + x).astype(np.int64)
    stats = [_bins(upper / n), _bins(digit / n), _bins(spaces / n), _bins(symbol / n), _bins(pipes / n), _bins(distinct), log(size), log(lines), log(size / (1 + lines)), log(2 * size / np.maximum(n_words, 1))]
    for k, value in enumerate([np.zeros(n_docs, np.int64), *stats]):
        hashes.append(splitmix(np.full(n_docs, 1000 * k + 77, _U) + value.astype(_U)))
        docs.append(np.arange(n_docs))
    key = np.unique(np.concatenate(docs) * CONTENT_DIMS + (np.concatenate(hashes) % _U(CONTENT_DIMS)).astype(np.int64))
    return (key % CONTENT_DIMS).astype(np.int32), np.bincount(key // CONTENT_DIMS, minlength=n_docs)


def _hash_strings(column: pa.Array) -> np.ndarray:
    """A hash of each string; null has its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "\0")
    coded = column.dictionary_encode()
    own = np.concatenate([span_hash(c.data, c.doc_start, c.doc_end) for c in chunks(coded.dictionary)] or [np.zeros(0, _U)])
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def page_features(batch: pa.RecordBatch) -> np.ndarray:
    """Six features of each row's metadata."""
    lang, source = _hash_strings(batch.column("lang")), _hash_strings(batch.column("source"))
    size = pc.fill_null(batch.column("n_chars"), -1).to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.floor(2 * np.log2(np.maximum(size, 0) + 1)).astype(np.int64) + np.where(size < 0, -1, 0)
    size = splitmix(size.view(_U) + _U(5))
    all_ = np.stack([np.full(len(lang), 3, _U), lang + _U(11), source + _U(12), splitmix(lang) + source, size, splitmix(source) + size], 1)
    return (splitmix(all_) % _U(PAGE_DIMS)).astype(np.int32)


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, content, page``: the features of both views of each row."""
    for batch in batches:
        page = page_features(batch)
        for chunk in chunks(batch.column("text")):
            rows = slice(chunk.first, chunk.first + chunk.n_docs)
            cols = [batch.column("doc_id")[rows], _list(*content_features(chunk)), _list(page[rows].reshape(-1), np.full(chunk.n_docs, page.shape[1]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "content", "page"])


_VIEWS = "doc_id long, content array<int>, page array<int>"


def _sums(weights: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features."""
    total = np.concatenate(([0.0], np.cumsum(weights[values], dtype=np.float64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _gradient(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, loss and gradient of both views over a task's rows; a null label leaves a row out of its view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        loss, out = 0.0, np.zeros(CONTENT_DIMS + PAGE_DIMS)
        for batch in batches:
            for view, label, at, dims in (("content", "content_good", 0, CONTENT_DIMS), ("page", "page_good", CONTENT_DIMS, PAGE_DIMS)):
                values, sizes = _flat(batch.column(view))
                y = batch.column(label).to_numpy(zero_copy_only=False)
                z, used = _sums(weights[at : at + dims], values, sizes), ~np.isnan(y)
                y = np.where(used, y, 0.0)
                loss += float((np.logaddexp(0.0, z) - y * z)[used].sum())
                gap = np.where(used, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
                out[at : at + dims] += np.bincount(values, np.repeat(gap, sizes), dims)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([out.tobytes()], pa.binary())], names=["loss", "gradient"])

    return run


def _fit(rows: DataFrame, weights: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Both views' weights by ``s.steps`` limited-memory quasi-Newton steps from ``weights``; each reads the rows' summed gradient."""
    sc, ridge = rows.sparkSession.sparkContext, s.ridge * n

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        shipped = sc.broadcast(w)
        parts = rows.mapInArrow(_gradient(shipped), "loss double, gradient binary").collect()  # one row of fixed size for each of FIT_TASKS tasks
        shipped.destroy()
        loss = sum(r["loss"] for r in parts) + 0.5 * ridge * float(w @ w)
        return loss, np.sum([np.frombuffer(bytes(r["gradient"])) for r in parts], axis=0) + ridge * w

    w, (loss, g), past = weights, evaluate(weights), []
    for _ in range(s.steps):
        d, kept = -g, []
        for ds, dg, rho in reversed(past):
            a = rho * float(ds @ d)
            d = d - a * dg
            kept.append(a)
        d = d * (float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).max())))
        for (ds, dg, rho), a in zip(past, reversed(kept), strict=True):
            d = d + (a - rho * float(dg @ d)) * ds
        t, slope = 1.0, float(g @ d)
        for _ in range(5):
            new_loss, new_g = evaluate(w + t * d)
            if new_loss <= loss + 1e-4 * t * slope:
                break
            t *= 0.3
        else:
            break
        ds, dg = t * d, new_g - g
        if float(ds @ dg) > 1e-12:
            past = [*past[-7:], (ds, dg, 1 / float(ds @ dg))]
        done = loss - new_loss < 1e-5 * loss
        w, loss, g = w + ds, new_loss, new_g
        if done:
            break
    return w


#: Tasks that share the labelled rows while fitting.
FIT_TASKS = 4


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a small dense logistic regression, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


@dataclass
class Judge:
    """Both views with their calibration and combination; ``cut`` is the least combined score that is kept."""

    weights: np.ndarray
    content: tuple[float, float] = (1.0, 0.0)
    page: tuple[float, float] = (1.0, 0.0)
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0, 0.0]))
    cut: float = 0.0

    def raw(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of a good document by content and by page, before calibration."""
        zc = [_sums(self.weights[:CONTENT_DIMS], *content_features(chunk)) for chunk in chunks(batch.column("text"))]
        page = page_features(batch)
        return np.concatenate(zc or [np.zeros(0)]), self.weights[CONTENT_DIMS:][page].sum(1)

    def calibrated(self, zc: np.ndarray, zp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.content[0] * zc + self.content[1], self.page[0] * zp + self.page[1]

    def mixed(self, zc: np.ndarray, zp: np.ndarray) -> np.ndarray:
        """A page that looks fine says little about what it says, so the lower view gets a say of its own."""
        return np.column_stack((zc, zp, np.minimum(zc, zp), np.ones(len(zc)))) @ self.both

    def calibrate(self, zc: np.ndarray, zp: np.ndarray, good: np.ndarray, share_kept: float) -> None:
        self.content, self.page = (tuple(fit_logistic(z[:, None], good).tolist()) for z in (zc, zp))
        zc, zp = self.calibrated(zc, zp)
        self.both = fit_logistic(np.column_stack((zc, zp, np.minimum(zc, zp))), good)
        self.cut = min(0.0, float(np.quantile(self.mixed(zc, zp)[good == 1], 1 - share_kept)))


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scored(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every row's scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Judge = shipped.value
        for batch in batches:
            zc, zp = judge.calibrated(*judge.raw(batch))
            z = judge.mixed(zc, zp)
            cols = [batch.column("doc_id"), batch.column("same"), *[pa.array(_odds(x)) for x in (zc, zp, z)], pa.array(z >= judge.cut)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "same", "content_score", "page_score", "score", "keep"])

    return run


def _kept(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that the judge keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Judge = shipped.value
        for batch in batches:
            yield batch.filter(pa.array(judge.mixed(*judge.calibrated(*judge.raw(batch))) >= judge.cut))

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def _score(docs: DataFrame, judge: Judge) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(judge)
    rows = _inputs(docs).withColumn("same", F.xxhash64("text"))
    return rows.mapInArrow(_scored(shipped), "doc_id long, same long, content_score double, page_score double, score double, keep boolean")


def cotrain(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Judge | None:
    """The two views, fitted in rounds; None where the labels do not hold both classes."""
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "quality")
    docs = _inputs(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    known = known.agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")).alias("good"))
    some = scratch.save(known.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.labelled), "labels")

    def views(wanted: DataFrame) -> DataFrame:
        """Features of the documents of a bounded table of ids, one row for each id."""
        rows = docs.join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(_views, _VIEWS)
        return rows.groupBy("doc_id").agg(F.min(F.struct("content", "page")).alias("v")).select("doc_id", "v.content", "v.page").join(F.broadcast(wanted), "doc_id")

    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    labelled = scratch.save(views(some).withColumn("held", held), "views")
    classes = {(r["held"], r["good"]): r["n"] for r in labelled.groupBy("held", "good").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 4:
        return None
    n = sum(v for (is_held, _), v in classes.items() if not is_held)
    lessons = labelled.where("not held").select("content", "page", F.col("good").alias("content_good"), F.col("good").alias("page_good"))
    judge = Judge(np.zeros(CONTENT_DIMS + PAGE_DIMS))
    for turn in range(s.rounds + 1):
        rows = lessons.coalesce(FIT_TASKS).persist()
        judge.weights = _fit(rows, judge.weights, n, s)
        rows.unpersist()
        # Held-out labels are bounded by the settings, so their scores fit on the driver.
        z = labelled.where("held").mapInArrow(_raw_of_views(judge.weights), "good double, zc double, zp double").toPandas()
        judge.calibrate(z["zc"].to_numpy(), z["zp"].to_numpy(), z["good"].to_numpy(), s.share_kept)
        release(spark)
        if turn == s.rounds:
            return judge
        # Of equal texts one may become a pseudo-label.
        fresh = _score(docs.where("doc_id is not null"), judge).join(known.select("doc_id"), "doc_id", "left_anti")
        fresh = fresh.groupBy("same").agg(F.min(F.struct("doc_id", "content_score", "page_score")).alias("d")).select("d.*")
        fresh = scratch.save(fresh.where((F.abs(F.col("content_score") - 0.5) >= s.confident - 0.5) | (F.abs(F.col("page_score") - 0.5) >= s.confident - 0.5)), "confident")
        picked = None
        for teacher, pupil in (("content", "page"), ("page", "content")):
            p = F.col(f"{teacher}_score")
            for good, sure, order in ((1.0, p >= s.confident, p.desc()), (0.0, p <= 1 - s.confident, p.asc())):
                own = fresh.where(sure).orderBy(order, F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.exchanged // 2)
                own = own.select("doc_id", *[F.lit(good if v == pupil else None).cast("double").alias(f"{v}_good") for v in ("content", "page")])
                picked = own if picked is None else picked.unionByName(own)
        picked = scratch.save(picked.groupBy("doc_id").agg(F.max("content_good").alias("content_good"), F.max("page_good").alias("page_good")), "picked")
        new = scratch.save(views(picked), "lessons")
        scratch.drop(fresh)
        lessons = labelled.where("not held").select("content", "page", F.col("good").alias("content_good"), F.col("good").alias("page_good")).unionByName(new.drop("doc_id"))
    return judge


def _raw_of_views(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [pa.array(_sums(w, *_flat(batch.column(c)))) for c, w in (("content", weights[:CONTENT_DIMS]), ("page", weights[CONTENT_DIMS:]))]
            yield pa.RecordBatch.from_arrays([batch.column("good"), *z], names=["good", "zc", "zp"])

    return run


def cotrain_and_score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents: ``doc_id, content_score, page_score, score, keep``.

    ``labels`` has ``doc_id, quality, toxic``; a document is good if its quality
    is 1 and it is not toxic (contradicting labels: it is not).  Fitting uses at
    most ``settings.labelled`` labels; pseudo-labels are drawn from all unlabelled
    documents, and every document is scored, over its whole text.

    Null or empty texts, null languages, sources and lengths have feature values
    of their own; repeated rows get equal scores; a null id is scored and
    reported as null; of rows that share a labelled id one is learned from; other
    columns are not read.  An empty table gives an empty result.  Where the
    labels do not hold both classes nothing can be learned: scores are null and
    everything is kept.
    """
    judge = cotrain(docs, labels, settings)
    if judge is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), nothing.alias("content_score"), nothing.alias("page_score"), nothing.alias("score"), F.lit(True).alias("keep"))
    return _score(docs, judge).drop("same")


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that ``cotrain_and_score`` keeps, each judged by itself, with all their columns."""
    judge = cotrain(docs, labels, settings)
    if judge is None:
        return docs
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(judge)), docs.schema)
