"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its pairs of neighbouring byte classes (letters, capitals, digits, marks ...)
and, binned, its shares of repeated words, repeated lines, repeated four-word runs, capitals and
marks.  A truncated singular value decomposition of the weighted term matrix of labelled rows gives
the latent space.  The labelled vectors are broadcast, every document's cosine to each of them is
computed exactly in blocks, and the `neighbours` nearest vote with weight similarity ** `power`.

Labelled rows are at most `reference_rows` (the documented bound of the fit, of rows with the
smallest hash of doc_id), so the broadcast holds at most reference_rows x (dimensions + 1) numbers.
Every document is scored, whole, where it is read; nothing is shuffled but the bounded sample.

Defined results: null texts count as empty; a text without any term gets the labelled rows' mean
label; without labelled rows every score is 0.5; of several labels of a doc_id the lowest counts,
null labels and labels without document count not at all; of several texts of a labelled doc_id one is learnt
from (that of the lowest hash); of equally near neighbours the one of the lowest doc_id counts; repeated rows
are scored alike; an empty table gives no rows; `keep_good` keeps all columns, `classify` and `score` ignore others.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import chunked, hash_spans, join_hash, run_hash, text_buffer, text_column, word_spans

REFERENCE_ROWS = 3000
#: Texts in one block of cosine products; bytes of text whose terms are counted at once.
BLOCK, TEXT_BYTES = 512, 1 << 20

_MARKS = b".,!%&*$#|-\"'()@:;"
CLASSES = 50
_CLASS = np.full(256, CLASSES - 1, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9:14] = 26, 27, 28, 29
_CLASS[list(_MARKS)] = 30 + np.arange(len(_MARKS))
_CLASS[128:192], _CLASS[192:] = 47, 48
_CAPITAL, _MARK, _LINE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK[list(_MARKS)] = True
_LINE[[10, 13]] = True
#: Lower bounds of the bins of shares; the weight of a bin against that of a text's pairs.
BINS = np.array([0.02, 0.06, 0.12, 0.25, 0.45, 0.7])
SHARE_WEIGHT = 0.6
SHARES = 5
TERMS = CLASSES * CLASSES
WIDTH = TERMS + SHARES * (len(BINS) + 1)


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of each document's keys that the same document has had before."""
    total = np.bincount(doc, minlength=n)
    own = np.sort(join_hash(keys, doc.astype(np.uint64)))
    same = own[1:] == own[:-1]
    if not same.any():
        return np.zeros(n)
    values, at = np.unique(join_hash(keys, doc.astype(np.uint64)), return_index=True)
    return (total - np.bincount(doc[at], minlength=n)) / np.maximum(total, 1)


def term_matrix(texts: pa.Array) -> np.ndarray:
    """log(1 + count) of each text's pairs, then the one-hot bins of its shares; a text without bytes has zeros."""
    data, offsets = text_buffer(texts)
    n, size = len(texts), int(offsets[-1])
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    code = _CLASS[data[:size]]
    out = np.zeros((n, WIDTH), np.float32)
    if size > 1:
        inner = doc[1:] == doc[:-1]
        pairs = np.bincount((doc[1:] * TERMS + code[:-1] * CLASSES + code[1:])[inner], minlength=n * TERMS)
        out[:, :TERMS] = np.log1p(pairs.reshape(n, TERMS).astype(np.float32))
    starts, stops, owner = word_spans(data, offsets)
    words = hash_spans(data, starts, stops)
    counts = np.bincount(owner, minlength=n)
    shares = np.zeros((SHARES, n))
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        shares[0] = np.bincount(owner[1:][again], minlength=n) / np.maximum(counts, 1)
    if len(words) > 4:
        inside = owner[3:] == owner[:-3]
        shares[1] = _repeats(run_hash(words, 4)[inside], owner[3:][inside], n)
    starts, stops, line = word_spans(data, offsets, _LINE)
    shares[2] = _repeats(hash_spans(data, starts, stops), line, n)
    for k, kind in ((3, _CAPITAL), (4, _MARK)):
        shares[k] = np.bincount(doc[kind[data[:size]]], minlength=n) / np.maximum(lengths, 1)
    full = np.flatnonzero(lengths)
    for k in range(SHARES):
        out[full, TERMS + k * (len(BINS) + 1) + np.searchsorted(BINS, shares[k][full], "right")] = 1
    return out


def _axes(z: np.ndarray, dimensions: int, spare: int = 8, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of z, by subspace iteration: nothing larger than z itself is held."""
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(z.shape[1], dimensions + spare)).astype(np.float32))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(z.T @ (z @ basis))[0]
    inner = (z @ basis).astype(np.float64)
    _, turn = np.linalg.eigh(inner.T @ inner)
    return (basis @ turn[:, ::-1][:, :dimensions]).astype(np.float32)


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dimensions: int):
        self.labels = labels.astype(np.float32)
        self.weight = np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
        self.axes = np.eye(WIDTH, dimensions, dtype=np.float32)
        z = self.weighted(terms)
        if len(terms):
            self.axes = _axes(z, dimensions)
        self.vectors = self.place(z)

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        z = terms * self.weight
        pairs = np.linalg.norm(z[:, :TERMS], axis=1, keepdims=True)
        z[:, :TERMS] /= np.maximum(pairs, 1e-9)
        z[:, TERMS:] = terms[:, TERMS:] * SHARE_WEIGHT
        return z

    def place(self, z: np.ndarray) -> np.ndarray:
        v = z @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, neighbours: int, power: int) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(terms), 0.5)
        k = min(neighbours, n)
        out = np.full(len(terms), float(self.labels.mean()))
        for at in range(0, len(terms), BLOCK):
            v = self.place(self.weighted(terms[at : at + BLOCK]))
            cosine = v @ self.vectors.T
            if k < n:
                # Of equal cosines (to five digits) the earlier vector is nearer.
                rank = np.rint(cosine * 1e5).astype(np.int64) * n - np.arange(n)
                top = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            else:
                top = np.tile(np.arange(n), (len(v), 1))
            vote = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(np.float64) ** power
            total = vote.sum(axis=1)
            some = total > 1e-12
            out[at : at + BLOCK][some] = ((vote * self.labels[top]).sum(axis=1)[some] / total[some]).clip(0, 1)
        return out.round(5)


def _remainder(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def _fitted(dimensions: int):
    """One task's whole sample, in order of _id, to the space's arrays."""

    def run(batches):
        rows = sorted((int(i), float(y), bytes(t)) for b in batches for i, y, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        terms = np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(len(rows), WIDTH).astype(np.float32)
        space, out = Space(terms, np.array([r[1] for r in rows], np.float32), dimensions), io.BytesIO()
        np.savez(out, **vars(space))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["space"])

    return run


def fit(docs: DataFrame, labels: DataFrame, reference_rows: int = REFERENCE_ROWS, dimensions: int = 32) -> Space:
    """A space from at most `reference_rows` labelled documents, fitted in one task; the driver gets its arrays only."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(reference_rows)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_hash"))

    def run(batches):
        for batch in chunked(batches, limit=TEXT_BYTES):
            terms = term_matrix(text_column(batch, "text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_label", "_hash")] + [pa.array([t.tobytes() for t in terms], pa.binary())], ["_id", "_label", "_hash", "terms"])

    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_label", "_hash", "text").mapInArrow(run, "_id long, _label int, _hash long, terms binary")
    # Rows of one doc_id count once, as the text of the lowest hash.
    rows = rows.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by("terms", "_hash").alias("terms"))
    found = rows.coalesce(1).mapInArrow(_fitted(dimensions), "space binary").collect()
    space = Space(np.zeros((0, WIDTH), np.float32), np.zeros(0), dimensions)
    if found:
        with np.load(io.BytesIO(bytes(found[0][0]))) as arrays:
            vars(space).update({k: arrays[k] for k in arrays.files})
    return space


def score(docs: DataFrame, space: Space, neighbours: int = 15, power: int = 8) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for batch in chunked(batches, limit=TEXT_BYTES):
            got = shared.value.score(term_matrix(text_column(batch, "text")), neighbours, power)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(got)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold (crc32 of doc_id) are never learnt from."""
    learn = labels.where(_remainder(F.col("doc_id"), folds) != held_out)
    got = score(docs, fit(docs, learn))
    return got.select("doc_id", (_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(_remainder(F.col("doc_id"), folds) != held_out)))

    def run(batches):
        for batch in chunked(batches, limit=TEXT_BYTES):
            good = shared.value.score(term_matrix(text_column(batch, "text")), 15, 8) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
