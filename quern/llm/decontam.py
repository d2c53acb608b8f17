"""Benchmark decontamination with suffix arrays over the corpus.

Every shard of documents (a bounded chunk of one task's rows) gets a word-level suffix array,
sorted by the first `window` words of each suffix.  Every suffix of the benchmark items is
binary-searched in it; the ranges found give all verbatim occurrences, which are extended word
by word to the longest matches and their locations.  Suffixes whose first words start no
benchmark window are left out of the array before sorting: they cannot be found.

There is no shuffle: documents stay where they are read, and only the benchmark travels, in
blocks of at most `BLOCK_BYTES`; each further block is one more pass that adds to the hits.

Defined results: null or word-less texts have no words and no hits; null or word-less items have
no windows; items that repeat an item_id count once; a null item_id marks words but is no item;
an empty table of either kind gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import chunked, expand, hash_spans, join_hash, sha256_hex, text_buffer, text_column, word_spans

#: Bytes of benchmark text that one broadcast holds at most.
BLOCK_BYTES = 16 << 20
#: Bytes of documents in one suffix array.
SHARD_BYTES = 6 << 20

#: Bytes that end a word: ASCII other than letters and digits.
DELIMITER = np.zeros(256, bool)
DELIMITER[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_at long, longest_item string"
CARRY = "doc_id long, text string, _hit binary, _items array<string>, _longest array<long>, _item string"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    data = _LOWER[data]
    starts, stops, doc = word_spans(data, offsets, DELIMITER)
    return hash_spans(data, starts, stops), doc


class Windows:
    """The benchmark's windows, over ids of its own words; id 0 is any other word."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        words, doc = _words(pa.array([t or "" for _, t in items], pa.large_string()))
        self.vocabulary = np.unique(words)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.table = np.zeros(1 << 20, bool)
        self.table[self.vocabulary & np.uint64(len(self.table) - 1)] = True
        counts = np.bincount(doc, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        #: Items' words one after another, a 0 after each item.
        at = np.arange(len(words)) + doc
        self.words = np.zeros(len(words) + len(items) + window + 1, np.int64)
        self.words[at] = self.ids(words)
        first = np.cumsum(counts + 1) - (counts + 1)
        lengths = np.minimum(counts, window)
        item, k = expand(np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0))
        begin, length = first[item] + k, lengths[item]
        grams = self.words[begin[:, None] + np.arange(window)] if len(begin) else np.zeros((0, window), np.int64)
        grams[np.arange(window) >= length[:, None]] = 0
        if len(grams):
            keys, back = np.unique(grams, axis=0, return_inverse=True)
        else:
            keys, back = grams, np.zeros(0, np.int64)
        back = back.ravel()
        self.length = (keys > 0).sum(axis=1)
        self.low = self.pack(keys)
        high = keys.copy()
        high[np.arange(len(keys)), self.length - 1] += 1
        self.high = self.pack(high)
        self.names = [i for i, _ in items]
        order = np.argsort(back, kind="stable")
        self.owner_item, self.owner_at = item[order], begin[order]
        self.owner_from = np.searchsorted(back[order], np.arange(len(keys) + 1))
        self.lead = int(min(3, self.length.min())) if len(keys) else 1
        self.leads = np.unique(self.fold(keys[:, : self.lead])) if len(keys) else np.zeros(0, np.uint64)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """1 and up for words of the benchmark, else 0."""
        out = np.zeros(len(words), np.int64)
        if len(self.vocabulary):
            near = np.flatnonzero(self.table[words & np.uint64(len(self.table) - 1)])
            at = np.minimum(np.searchsorted(self.vocabulary, words[near]), len(self.vocabulary) - 1)
            out[near] = np.where(self.vocabulary[at] == words[near], at + 1, 0)
        return out

    def fold(self, grams: np.ndarray) -> np.ndarray:
        out = grams[:, 0].astype(np.uint64)
        for k in range(1, grams.shape[1]):
            out = join_hash(out, grams[:, k].astype(np.uint64))
        return out

    def pack(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ids as fixed-width strings of bytes in the same order."""
        per = max(1, 63 // self.bits)
        parts = -(-grams.shape[1] // per)
        keys = np.zeros((len(grams), parts), ">u8")
        for k in range(grams.shape[1]):
            keys[:, k // per] += grams[:, k].astype(np.uint64) << np.uint64(self.bits * (per - 1 - k % per))
        return keys.view(f"S{8 * parts}").ravel()

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and window number of every occurrence in ids, in which 0 ends documents."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.low) or not len(ids):
            return none
        padded = np.concatenate([ids, np.zeros(self.window, np.int64)])
        starts = np.flatnonzero(ids > 0)
        for k in range(1, self.lead):
            starts = starts[padded[starts + k] > 0]
        if not len(starts):
            return none
        lead = self.fold(padded[starts[:, None] + np.arange(self.lead)])
        at = np.minimum(np.searchsorted(self.leads, lead), len(self.leads) - 1)
        starts = starts[self.leads[at] == lead]
        if not len(starts):
            return none
        grams = padded[starts[:, None] + np.arange(self.window)]
        grams[np.cumsum(grams == 0, axis=1) > 0] = 0
        keys = self.pack(grams)
        order = np.argsort(keys, kind="stable")
        array, suffixes = keys[order], starts[order]
        lo, hi = np.searchsorted(array, self.low), np.searchsorted(array, self.high)
        which, k = expand(np.maximum(hi - lo, 0))
        return suffixes[lo[which] + k], which

    def extend(self, padded: np.ndarray, position: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, item, words) of the longest match from each occurrence, for each item that has the window."""
        occurrence, k = expand(self.owner_from[which + 1] - self.owner_from[which])
        owner = self.owner_from[which[occurrence]] + k
        item, at, size = self.owner_item[owner], self.owner_at[owner], self.length[which[occurrence]].astype(np.int64)
        begin = position[occurrence]
        alive = np.arange(len(occurrence))
        while len(alive):
            word = padded[begin[alive] + size[alive]]
            alive = alive[(word > 0) & (word == self.words[at[alive] + size[alive]])]
            size[alive] += 1
        return occurrence, item, size


def _scan(windows, first: bool, last: bool):
    def run(batches):
        index: Windows = windows.value
        for batch in chunked(batches, limit=SHARD_BYTES):
            texts, n = text_column(batch, "text"), batch.num_rows
            words, doc = _words(texts)
            counts = np.bincount(doc, minlength=n)
            begin = np.cumsum(counts + 1) - (counts + 1)
            ids = np.zeros(len(words) + n, np.int64)
            ids[np.arange(len(words)) + doc] = index.ids(words)
            position, which = index.search(ids)
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, position, 1)
            np.add.at(cover, position + index.length[which], -1)
            hit = np.cumsum(cover[:-1]) > 0
            slot_doc = np.repeat(np.arange(n), counts + 1)
            found: list[set] = [set() for _ in range(n)]
            best: list[tuple] = [(0, 0, "")] * n
            if len(position):
                padded = np.concatenate([ids, np.zeros(index.window + 1, np.int64)])
                occurrence, item, size = index.extend(padded, position, which)
                row = slot_doc[position[occurrence]]
                for d, i in np.unique(np.stack([row, item], 1), axis=0):
                    if index.names[i] is not None:
                        found[d].add(index.names[i])
                order = np.lexsort((item, position[occurrence], -size, row))
                for j in order[np.flatnonzero(np.diff(row[order], prepend=-1))]:
                    d = row[j]
                    best[d] = (int(size[j]), int(position[occurrence[j]] - begin[d]), index.names[item[j]] or "")
            if not first:
                for d, (old, items, longest, name) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_hit", "_items", "_longest", "_item")), strict=True)):
                    bits = np.unpackbits(np.frombuffer(old, np.uint8), count=int(counts[d]))
                    hit[begin[d] : begin[d] + counts[d]] |= bits.astype(bool)
                    found[d] |= set(items)
                    best[d] = min(best[d], (longest[0], longest[1], name), key=lambda x: (-x[0], x[1], x[2]))
            ident = batch.column(batch.schema.get_field_index("doc_id"))
            if last:
                hits = np.bincount(slot_doc, hit, minlength=n).astype(np.int64)
                names = [",".join(sorted(x)) for x in found]
                longest = [b if b[0] else (0, None, None) for b in best]
                cols = [ident, counts, hits, [len(x) for x in found], [sha256_hex(x.encode()) for x in names], hits > 0, [b[0] for b in longest], pa.array([b[1] for b in longest], pa.int64()), pa.array([b[2] for b in longest], pa.string())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_at", "longest_item"])
            else:
                bits = [np.packbits(hit[begin[d] : begin[d] + counts[d]]).tobytes() for d in range(n)]
                yield pa.RecordBatch.from_arrays([ident, texts.cast(pa.string()), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([[b[0], b[1]] for b in best], pa.list_(pa.int64())), pa.array([b[2] for b in best], pa.string())], ["doc_id", "text", "_hit", "_items", "_longest", "_item"])

    return run


def _blocks(benchmark: DataFrame, window: int):
    """The windows of each block of the benchmark, one broadcast at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted({(r[0], r[1]) for r in part.collect()}, key=lambda r: (r[0] or "", r[1] or ""))
        yield b == 0, b == blocks - 1, benchmark.sparkSession.sparkContext.broadcast(Windows(rows, window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the longest verbatim
    match (words, first word in the document, item).  See the module's docstring for edge cases."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for first, last, shared in _blocks(benchmark, window):
        out = out.mapInArrow(_scan(shared, first, last), OUT if last else CARRY)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows, with their columns, whose text has no hit word; one pass over the texts for each block of the benchmark."""

    def keep(windows):
        def run(batches):
            index: Windows = windows.value
            for batch in chunked(batches, limit=SHARD_BYTES):
                words, doc = _words(text_column(batch, "text"))
                ids = np.zeros(len(words) + batch.num_rows, np.int64)
                ids[np.arange(len(words)) + doc] = index.ids(words)
                position, _ = index.search(ids)
                slots = np.bincount(doc, minlength=batch.num_rows) + 1
                good = np.ones(batch.num_rows, bool)
                good[np.repeat(np.arange(batch.num_rows), slots)[position]] = False
                yield batch.filter(pa.array(good))

        return run

    for _, _, shared in _blocks(benchmark, window):
        docs = docs.mapInArrow(keep(shared), docs.schema)
    return docs
