"""Vectorised text primitives on Arrow string columns.

All functions work on a chunk of documents laid out as one byte buffer, so the
cost per byte is a handful of numpy passes and no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64

#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(BASE, -1, 2**64)

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes per chunk: small enough that the work arrays stay in cache.
CHUNK = 1 << 19


def splitmix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


#: A fixed random odd value for each byte.
BYTE_VALUE = splitmix(np.arange(1, 257, dtype=_U)) | _U(1)

_power_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    out = _power_cache.get((base, size))
    if out is None:
        out = np.ones(size, _U)
        filled = 1
        while filled < size:
            step = _U(pow(base, filled, 2**64))
            out[filled : 2 * filled] = out[:filled] * step
            filled *= 2
        if size <= 1 << 22:
            _power_cache[(base, size)] = out
    return out[:n]


class Chunk:
    """Documents ``first .. first + n_docs - 1`` of a batch as one byte buffer."""

    __slots__ = ("data", "doc_start", "doc_end", "first", "n_docs")

    def __init__(self, data: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, first: int):
        self.data, self.doc_start, self.doc_end, self.first = data, doc_start, doc_end, first
        self.n_docs = len(doc_start)

    def text(self, i: int) -> bytes:
        return self.data[self.doc_start[i] : self.doc_end[i]].tobytes()


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``size`` bytes (null: empty).

    A document longer than ``size`` is a chunk of its own, never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        lo = offsets[i]
        yield Chunk(data[lo : offsets[j]], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo, i)
        i = j


def spans(inside: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of ``inside`` bytes.

    Runs never cross documents.
    """
    n = len(inside)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    heads = chunk.doc_start[chunk.doc_start < chunk.doc_end]
    begins[heads] = inside[heads]
    tails = chunk.doc_end[chunk.doc_start < chunk.doc_end] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(chunk.doc_start, start, side="right") - 1
    return start, end, doc


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; equal bytes give equal hashes."""
    if len(start) == 0:
        return np.zeros(0, _U)
    n = len(data)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=total[1:])
    raw = (total[end] - total[start]) * powers(_BASE_INV, n + 1)[start]
    return splitmix(raw + (end - start).astype(_U) * _U(0xD1B54A32D192ED03))


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and hash of each word, A-Z lower-cased."""
    data = LOWER[chunk.data]
    start, end, doc = spans(~SPACE[data], chunk)
    return start, end, doc, span_hash(data, start, end)


def shingles(word_hash: np.ndarray, word_doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each document.

    Returns hashes sorted within each document, their documents, and the number
    per document.  A document of fewer than ``width`` words has one shingle,
    its whole sequence; a document without words has none.
    """
    n = len(word_hash)
    counts = np.bincount(word_doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
    step = _U(0xA0761D6478BD642F)
    if n >= width:
        acc = word_hash[: n - width + 1].copy()
        for k in range(1, width):
            acc *= step
            acc += word_hash[k : n - width + 1 + k]
        whole = word_doc[: n - width + 1] == word_doc[width - 1 :]
        grams, docs = splitmix(acc[whole]), word_doc[: n - width + 1][whole]
    else:
        grams, docs = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = np.zeros(len(short), _U)
        for k in range(width - 1):
            live = counts[short] > k
            extra[live] = extra[live] * step + word_hash[begin[live] + k] + _U(k + 1)
        grams = np.concatenate((grams, splitmix(extra + counts[short].astype(_U))))
        docs = np.concatenate((docs, short))
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    if len(grams):
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
        grams, docs = grams[keep], docs[keep]
    return grams, docs, np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
