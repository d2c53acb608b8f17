"""Substring de-duplication with difference-cover anchors.

A window is `WINDOW` consecutive words of one document.  Positions whose remainder modulo `PERIOD`
lies in a difference cover are anchors: for any two positions some offset below PERIOD moves both to
anchors.  So two equal windows share two equal anchor hashes, each of WINDOW - PERIOD + 1 words that
lie within the windows.  First the anchors that occur more than once in the corpus are found; then
each is extended to all windows that contain it, and those windows' 128-bit hashes are compared.
Every repeated window is found, and nothing else (but for a collision of 128 bits).

Documents are dealt into chunks by doc_id.  A chunk sends each of its distinct hashes once, in one
binary value for each bucket of hashes, and gets back those that occur elsewhere; so a passage that a
third of all documents share costs one entry a chunk, no bucket's size depends on how often a hash
occurs, and hashes never become single rows.  Chunks and buckets grow in number with the input.

Defined results: null, empty and short texts (fewer words than a window) lose nothing; repeated rows
are copies of one another; rows keep their doc_id, repeated or null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import hash_spans, run_hash, sha256_hex, text_buffer, text_column, word_spans

WINDOW = 35
#: A perfect difference set; each difference but 0 modulo 21 occurs once.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Text of a chunk, and text whose hashes share a bucket, at sizes where these decide.
CHUNK_TEXT, BUCKET_TEXT = 16 << 20, 512 << 20

_BLOB = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
_VERDICT = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary())])


class _Chunk:
    """Words of a chunk's documents."""

    def __init__(self, table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        self.ids = batch.column(batch.schema.get_field_index("doc_id"))
        self.data, self.offsets = text_buffer(text_column(batch, "text"))
        self.starts, self.stops, self.doc = word_spans(self.data, self.offsets)
        self.n = batch.num_rows
        self.counts = np.bincount(self.doc, minlength=self.n)
        self.first = np.cumsum(self.counts) - self.counts
        self.words = hash_spans(self.data, self.starts, self.stops)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of documents that have a window."""
        at = np.arange(len(self.words)) - self.first[self.doc]
        size = self.counts[self.doc]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        where = np.flatnonzero(cover[at % PERIOD] & (at + ANCHOR <= size) & (size >= WINDOW))
        return where, run_hash(self.words, ANCHOR)[where] if len(where) else np.zeros(0, np.uint64)

    def windows(self) -> np.ndarray:
        """Whether a window starts at each word."""
        return np.arange(len(self.words)) - self.first[self.doc] + WINDOW <= self.counts[self.doc]

    def window_hashes(self, where: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each window; n x 2."""
        if not len(where):
            return np.zeros((0, 2), np.uint64)
        other = hash_spans(self.data, self.starts, self.stops, seed=1)
        return np.stack([run_hash(self.words, WINDOW)[where], run_hash(other, WINDOW)[where]], 1)


def _rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit numbers as single comparable values."""
    return hashes.ravel() if hashes.shape[1] == 1 else np.ascontiguousarray(hashes.astype(">u8")).view(f"S{8 * hashes.shape[1]}").ravel()


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted, and how often each occurs."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    order = np.argsort(hashes[:, 0], kind="stable") if hashes.shape[1] == 1 else np.lexsort(hashes.T[::-1])
    hashes = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]).any(axis=1)]))
    return hashes[begins], np.diff(np.append(begins, len(hashes)))


def _send(chunk: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket of the chunk's distinct hashes: those that occur in it once, and more often."""
    found, times = _distinct(hashes)
    bucket = (found[:, 0] >> np.uint64(20)) % np.uint64(buckets) if len(found) else np.zeros(0, np.uint64)
    order = np.argsort(bucket, kind="stable")
    found, times, bucket = found[order], times[order], bucket[order]
    names, at = np.unique(bucket, return_index=True)
    ends = np.append(at, len(bucket))[1:]
    once = [found[a:b][times[a:b] == 1].tobytes() for a, b in zip(at, ends, strict=True)]
    more = [found[a:b][times[a:b] > 1].tobytes() for a, b in zip(at, ends, strict=True)]
    return pa.table([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), chunk)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=_BLOB)


def _send_anchors(buckets: int):
    def run(key, table):
        return _send(key[0].as_py(), _Chunk(table).anchors()[1][:, None], buckets)

    return run


def _resolve(width: int):
    """A bucket's hashes that occur more than once, for each chunk that has them."""

    def run(table):
        chunks = table.column("chunk").to_numpy()
        parts = [(c, np.frombuffer(x, np.uint64)) for name in ("once", "more") for c, x in zip(chunks, table.column(name).to_pylist(), strict=True)]
        sizes = np.array([len(x) // width for _, x in parts])
        hashes = np.concatenate([x for _, x in parts]).reshape(-1, width)
        owner = np.repeat(np.array([c for c, _ in parts]), sizes)
        often = np.repeat(np.arange(len(parts)) >= len(chunks), sizes)
        order = np.lexsort(hashes.T[::-1])
        hashes, owner, often = hashes[order], owner[order], often[order]
        same = (hashes[1:] == hashes[:-1]).all(axis=1) if len(hashes) else np.zeros(0, bool)
        again = often.copy()
        again[1:] |= same
        again[:-1] |= same
        hashes, owner = hashes[again], owner[again]
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
        names, at = np.unique(owner, return_index=True)
        return pa.table([pa.array(names, pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in zip(at, np.append(at, len(owner))[1:], strict=True)], pa.binary())], schema=_VERDICT)

    return run


def _told(verdict: pa.Table, width: int) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in verdict.column("hashes").to_pylist()]
    return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width), np.uint64)


def _among(hashes: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether each row of hashes is one of those told; a table of bits settles most."""
    out = np.zeros(len(hashes), bool)
    if len(told) and len(hashes):
        bits = np.zeros(1 << 22, bool)
        bits[told[:, 0] & np.uint64(len(bits) - 1)] = True
        near = np.flatnonzero(bits[hashes[:, 0] & np.uint64(len(bits) - 1)])
        known = np.sort(_rows(told))
        rows = _rows(hashes[near])
        at = np.minimum(np.searchsorted(known, rows), len(known) - 1)
        out[near] = known[at] == rows
    return out


def _send_windows(buckets: int):
    def run(key, table, verdict):
        chunk = _Chunk(table)
        where, hashes = chunk.anchors()
        marks = np.zeros(len(chunk.words) + PERIOD + 1, np.int64)
        marks[1 + where[_among(hashes[:, None], _told(verdict, 1))]] = 1
        sums = np.cumsum(marks)
        at = np.arange(len(chunk.words))
        # A window holds the anchors that begin at its first PERIOD words.
        candidates = np.flatnonzero((sums[at + PERIOD] > sums[at]) & chunk.windows())
        return _send(key[0].as_py(), chunk.window_hashes(candidates), buckets)

    return run


def _cut(keep_text: bool):
    def run(key, table, verdict):
        chunk = _Chunk(table)
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        told = _told(verdict, 2)
        if len(told):
            every = np.flatnonzero(chunk.windows())
            again = every[_among(chunk.window_hashes(every), told)]
            cover[again] += 1
            np.add.at(cover, again + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.bincount(chunk.doc[gone], minlength=chunk.n)
        raw = chunk.data.tobytes()
        kept = []
        for d in range(chunk.n):
            words = raw[chunk.offsets[d] : chunk.offsets[d + 1]].split()
            if removed[d]:
                stays = ~gone[chunk.first[d] : chunk.first[d] + chunk.counts[d]]
                words = [words[k] for k in np.flatnonzero(stays)]
            kept.append(b" ".join(words))
        last = pa.array([k.decode() for k in kept], pa.string()) if keep_text else pa.array([sha256_hex(k) for k in kept], pa.string())
        return pa.table([chunk.ids, pa.array(chunk.counts), pa.array(removed), last], ["doc_id", "n_words", "n_removed", "kept" if keep_text else "kept_sha256"])

    return run


def _size(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _run(docs: DataFrame, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, size = int(spark.conf.get("spark.sql.shuffle.partitions")), _size(docs)
    chunks, buckets = max(2 * parts, size // CHUNK_TEXT), max(parts, size // BUCKET_TEXT)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    blob, verdict = "bucket int, chunk long, once binary, more binary", "chunk long, hashes binary"
    anchors = docs.groupBy("chunk").applyInArrow(_send_anchors(buckets), blob)
    told = anchors.groupBy("bucket").applyInArrow(_resolve(1), verdict)
    windows = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_send_windows(buckets), blob)
    told = windows.groupBy("bucket").applyInArrow(_resolve(2), verdict)
    out = f"doc_id long, n_words long, n_removed long, {'kept' if keep_text else 'kept_sha256'} string"
    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut(keep_text), out)


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every row."""
    return _run(docs, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the kept words joined by one space."""
    return _run(docs, True)
