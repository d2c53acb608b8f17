"""Shared numpy building blocks: Arrow text buffers, word spans, 64-bit hashes, chunking.

Texts travel as UTF-8 Arrow buffers and are never turned into Python strings unless an
operator needs characters.  All helpers are pure functions of their arguments.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
CHUNK_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: White space of the word pattern [^\x20\x09-\x0D]+ as a mask over bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large strings, nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()).fill_null("")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes (followed by 8 zero bytes) and their n+1 offsets, from 0."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.zeros(last - first + 8, np.uint8)
    if last > first:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)
    return data, offsets - first


#: What a stage keeps in its Python worker from task to task; the next stage of another kind in that worker drops it.
HELD: dict = {}


def _freed() -> None:
    """Gives unused memory back to the machine: Python workers are kept for later stages, and with them what they once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunked(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = CHUNK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, but one row at least.  keep: what is held is this stage's own."""
    if not keep:
        HELD.clear()
    _freed()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(text_column(batch, name)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    _freed()


def text_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run of non-delimiter bytes; no run crosses documents."""
    size = int(offsets[-1])
    inside = np.zeros(size + 2, bool)
    np.logical_not(delimiter[data[:size]], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, stops, np.repeat(np.arange(len(offsets) - 1), counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; changes x in place."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; data ends with 8 spare bytes."""
    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = stops - starts
    out = length.astype(np.uint64) * _K1 + np.uint64((seed * 0x632BE59BD9B4E019 + 1) & 0xFFFFFFFFFFFFFFFF)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    which, at = None, 0
    while True:
        left = length - at if which is None else length[which] - at
        begin = starts if which is None else starts[which]
        part = loads[begin + at] & masks[np.minimum(left, 8)]
        if which is None:
            out ^= part
            mix(out)
        else:
            out[which] = mix((out[which] * _K2) ^ part)
        at += 8
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        which = more if which is None else which[more]


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a followed by b."""
    return mix(a * _K1 + (b ^ (b >> np.uint64(29))) * _K2 + np.uint64(0x2545F4914F6CDD1D))


def run_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` consecutive words from every position that has so many; by doubling."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    powers, size = [(1, words)], 1
    while size * 2 <= length:
        last = powers[-1][1]
        powers.append((size * 2, join_hash(last[:-size], last[size:])))
        size *= 2
    out, done = None, 0
    for size, part in reversed(powers):
        if length - done >= size:
            out = part if out is None else join_hash(out[: len(words) - done - size + 1], part[done : len(words) - size + 1])
            done += size
    return out[: len(words) - length + 1]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts' units: which entry it belongs to, and its number within the entry."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
