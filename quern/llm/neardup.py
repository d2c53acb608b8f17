"""MinHash near-duplicate groups by ProbMinHash over weighted word shingles.

Shingles are five consecutive words ([^\\x20\\x09-\\x0D]+, unchanged); a text of fewer words is one
shingle.  A shingle's weight in a text is 1 + ln(times it occurs).  Each weighted shingle sends a
Poisson process of arrivals, of the rate of its weight, to `REGISTERS` registers; a register keeps
the shingle that arrives first.  Arrivals are drawn up to a limit that grows only for texts with
empty registers, so a long text costs little more than its shingles' first arrivals.  Two texts'
registers agree with the probability of their probability Jaccard similarity (the plain Jaccard
similarity where no shingle repeats).

Texts of the same words form one node.  Nodes that share a band of registers are candidates; every
link is verified by the exact probability Jaccard similarity of the whole texts.  A bucket isn't turned
into its pairs: each node is compared with its best bucket's first node, then with the first nodes of its
other buckets that lie in other components.  In buckets that still hold several components, the nodes
outside the largest of them meet all others in blocks of bounded size, where posting lists of shingles
give the exact similarities; a block sends the links of a spanning forest only.  So every candidate
pair of different components is compared exactly; what bands miss is missed (a link of similarity 0.8 by
all 20 bands about once in 36,000).  Buckets, pivots, texts and groups that hold many rows are dealt out.

Defined results: null, empty or white texts have no shingles and form groups of their own; a row without
doc_id is in no group (null class); rows of one doc_id with different texts are grouped each by its own
text, and rows that repeat doc_id and text share a class; of a group all rows of its lowest doc_id are kept;
an empty table gives no rows; other columns are ignored by `near_duplicates` and kept, whatever their
names, by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import chunked, expand, hash_spans, join_hash, mix, run_hash, text_buffer, text_column, word_spans
from quern.llm.tables import dealt_join, written

SHINGLE = 5
#: Registers of a text, in bands.
BANDS, ROWS_PER_BAND = 20, 4
REGISTERS = BANDS * ROWS_PER_BAND
#: Links that one task unites: 16 bytes each; more go the distributed way.
LOCAL_LINKS = 1 << 20
#: Nodes and words of a bucket's part in one block of comparisons.
BLOCK, BLOCK_WORDS = 1000, 1 << 20

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles' document, hash and weight; words' hashes and documents."""
    data, offsets = text_buffer(texts)
    starts, stops, doc = word_spans(data, offsets)
    words = hash_spans(data, starts, stops)
    n = len(texts)
    counts = np.bincount(doc, minlength=n)
    grams = run_hash(words, SHINGLE)
    inside = doc[SHINGLE - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    owner, keys = doc[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begin = np.cumsum(counts) - counts
        whole = []
        for d in short:
            h = words[begin[d] : begin[d] + 1]
            for k in range(1, counts[d]):
                h = join_hash(h, words[begin[d] + k : begin[d] + k + 1])
            whole.append(int(h[0]))
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, np.array(whole, np.uint64)])
    tagged = join_hash(keys, owner.astype(np.uint64))
    _, first, times = np.unique(tagged, return_index=True, return_counts=True)
    return owner[first], keys[first], 1 + np.log(times), words, doc


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def registers(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, size: int = REGISTERS) -> np.ndarray:
    """The low 32 bits of the shingle that arrives first at each register; n x size, 0 for documents without shingles."""
    best = np.full(n * size, _EMPTY, np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    limit = size * (math.log(size) + 2) / np.maximum(total, 1e-9)
    tag = mix(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)
    doc, key, rate, tag = owner, keys, weight, tag
    times = np.ones(len(key), np.uint64)
    draw = mix(key + times * np.uint64(0x9E3779B97F4A7C15))
    arrival = -np.log(_uniform(draw)) / rate
    while len(doc):
        go = np.arange(len(doc))
        while True:
            go = go[arrival[go] <= limit[doc[go]]]
            if not len(go):
                break
            where = mix(draw[go] ^ np.uint64(0xA0761D6478BD642F))
            slot = doc[go] * size + (where % np.uint64(size)).astype(np.int64)
            packed = (arrival[go].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | tag[go]
            np.minimum.at(best, slot, packed)
            times[go] += np.uint64(1)
            draw[go] = mix(key[go] + times[go] * np.uint64(0x9E3779B97F4A7C15))
            arrival[go] -= np.log(_uniform(draw[go])) / rate[go]
        lacking = (best.reshape(n, size) == _EMPTY).any(axis=1)
        limit[lacking] *= 2
        keep = lacking[doc]
        doc, key, rate, tag, times, draw, arrival = (x[keep] for x in (doc, key, rate, tag, times, draw, arrival))
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, size)
    out[total == 0] = 0
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of registers and its number."""
    rows = values.astype(np.uint64).reshape(len(values), BANDS, ROWS_PER_BAND)
    out = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64) + np.uint64(1), rows.shape[:2]).copy()
    for k in range(ROWS_PER_BAND):
        out = join_hash(out, rows[:, :, k])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two sets of (sorted distinct keys, weights)."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])], y[np.searchsorted(keys, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    at = np.searchsorted(ratio, ratio, "left")
    below = np.concatenate([[0], np.cumsum(x)])[at]
    above = np.concatenate([np.cumsum(y[::-1])[::-1], [0]])[at]
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def _signatures(batches):
    for batch in chunked(batches):
        n = batch.num_rows
        owner, keys, weight, words, doc = shingles(text_column(batch, "text"))
        ends = np.searchsorted(doc, np.arange(n + 1))
        raw = words.tobytes()
        digest = [hashlib.md5(raw[ends[d] * 8 : ends[d + 1] * 8], usedforsecurity=False).digest() for d in range(n)]
        halves = np.frombuffer(b"".join(digest), np.int64).reshape(n, 2)
        hashed = bands(registers(owner, keys, weight, n))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "th")), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.diff(ends)), pa.array(list(hashed), pa.list_(pa.int64()))],
            ["doc_id", "th", "k1", "k2", "n_words", "bands"],
        )


def _sides(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted shingles and their weights."""
    owner, keys, weight, _, _ = shingles(texts)
    order = np.lexsort((keys, owner))
    ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [(keys[order[a:b]], weight[order[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]


def _links(threshold: float):
    def run(batches):
        for some in chunked(batches, "text", 1 << 20):
            for batch in chunked([some], "pivot_text", 4 << 20):
                # Rows come by pivot: its text is taken apart once for all of them.
                pivot = batch.column(batch.schema.get_field_index("pivot")).to_numpy()
                first = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
                pivots = _sides(text_column(batch, "pivot_text").take(pa.array(first)))
                which = np.searchsorted(first, np.arange(len(pivot)), "right") - 1
                good = [similarity(a, pivots[k]) >= threshold - 1e-9 for a, k in zip(_sides(text_column(batch, "text")), which, strict=True)]
                yield batch.select(["node", "pivot"]).filter(pa.array(good, pa.bool_()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (node, pivot), those whose texts (node, text) are so similar.  A pivot of many pairs is dealt out in copies."""
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
    left = pairs.select("node", "pivot").join(texts, "node")
    right = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    both = dealt_join(left, right, ["pivot"], sizes, "node").select("node", "pivot", "text", "pivot_text")
    return both.mapInArrow(_links(threshold), "node long, pivot long")


def _united(batches):
    """Union-find over one task's links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the lowest node of each linked node's component.  Up to LOCAL_LINKS links are united by one task;
    beyond, labels of neighbours spread and are followed to their own labels until nothing changes, over any number of tasks."""
    if links.count() <= LOCAL_LINKS:
        return written(links.select("node", "pivot").coalesce(1).mapInArrow(_united, "node long, label long"), "labels")
    edges = written(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")).unionByName(links.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("_n"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("_old"), F.least("label", "_n").alias("_m"))
        jump = labels.select(F.col("node").alias("_m"), F.col("label").alias("_j"))
        new = written(spread.join(jump, "_m", "left").select("node", "_old", F.least("_m", F.coalesce("_j", "_m")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> _old").isEmpty():
            return labels


def forest(label: np.ndarray, side: np.ndarray, texts: pa.Array, threshold: float) -> list[tuple[int, int]]:
    """Links that join the labels of so similar texts, a spanning forest of them: texts of side 0 and 2 are compared with those of side 1 and 2."""
    owner, keys, weight, _, _ = shingles(texts)
    n, least = len(texts), threshold - 1e-9
    values, code = np.unique(keys, return_inverse=True)
    code = code.ravel()
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    ends = np.searchsorted(owner, np.arange(n + 1))
    by_code = np.argsort(code, kind="stable")
    start = np.searchsorted(code[by_code], np.arange(len(values) + 1))
    mass, size = np.bincount(owner, weight, minlength=n), np.diff(ends)
    plain = np.bincount(owner, weight != 1, minlength=n) == 0
    root = np.unique(label, return_inverse=True)[1].ravel()
    found = []
    for q in np.flatnonzero(side != 1):
        open_ = (side != 0) & (root != root[q])
        if not open_.any():
            continue
        own = slice(ends[q], ends[q + 1])
        lists = start[code[own]]
        which, k = expand(start[code[own] + 1] - lists)
        at = by_code[lists[which] + k]
        # A text's similarity is at most the share of its weight that the other has as well, on either side.
        near = open_ & (np.bincount(owner[at], weight[own][which], minlength=n) >= least * mass[q]) & (np.bincount(owner[at], weight[at], minlength=n) >= least * mass)
        if plain[q] and near.any():
            common = np.bincount(owner[at], minlength=n)
            near &= ~plain | (common >= least * (size[q] + size - common))
        for o in np.flatnonzero(near):
            if root[o] == root[q]:
                continue
            if not (plain[q] and plain[o]) and similarity((code[own], weight[own]), (code[ends[o] : ends[o + 1]], weight[ends[o] : ends[o + 1]])) < least:
                continue
            found.append((int(q), int(o)))
            root[root == root[o]] = root[q]
    return found


def _cross(threshold: float):
    """The links of each block (rows of one bh, kind, i and j, which come together)."""

    def flush(rows):
        node = np.array([r[0] for r in rows])
        pairs = forest(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.large_string()), threshold)
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        a, b = node[ends[:, 0]], node[ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["node", "pivot"])

    def run(batches):
        rows, key = [], None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bh", "kind", "i", "j", "node", "label", "side", "text")]
            for *now, node, label, side, text in zip(*cols, strict=True):
                if now != key and rows:
                    yield flush(rows)
                    rows = []
                key = now
                rows.append((node, label, side, text))
        if rows:
            yield flush(rows)

    return run


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes lie in different components."""
    a, b = labels.select("node", F.col("label").alias("_a")), labels.select(F.col("node").alias("pivot"), F.col("label").alias("_b"))
    return pairs.join(a, "node", "left").join(b, "pivot", "left").where(F.coalesce("_a", "node") != F.coalesce("_b", "pivot")).select("node", "pivot")


def _met_in_blocks(met: DataFrame, buckets: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between components that share a bucket of three nodes and more: all nodes outside a bucket's largest component against all."""
    placed = met.where("n > 2").join(labels, "node", "left").select("bh", "node", "words", F.coalesce("label", "node").alias("label"))
    parts = placed.groupBy("bh", "label").agg(F.count("*").alias("c"), F.sum("words").alias("w"))
    largest = F.max(F.struct("c", "label", "w")).alias("top")
    mixed = parts.groupBy("bh").agg(F.count("*").alias("_labels"), F.sum("c").alias("_c"), F.sum("w").alias("_w"), largest).where("_labels > 1")
    number = lambda c, w: F.ceil(F.greatest(c / F.lit(BLOCK), w / F.lit(BLOCK_WORDS), F.lit(1.0))).cast("int")
    mixed = mixed.select("bh", F.col("top.label").alias("major"), number(F.col("_c") - F.col("top.c"), F.col("_w") - F.col("top.w")).alias("minors"), number(F.col("top.c"), F.col("top.w")).alias("majors"))
    known = dealt_join(placed, mixed, ["bh"], buckets.select("bh", "n"), "node").withColumn("minor", F.col("label") != F.col("major"))
    known = known.select("bh", "node", "label", "minor", "minors", "majors", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int").alias("b")).join(texts, "node")
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    b = F.col("b")
    others = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda o: place(0, F.least(o, b), F.greatest(o, b), F.when(o == b, 2).when(b < o, 0).otherwise(1)))
    against = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda o: place(1, b, o, F.lit(0)))
    met_by = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda o: place(1, o, b, F.lit(1)))
    dealt = known.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(others, against)).otherwise(met_by)))
    dealt = dealt.select("bh", "at.kind", "at.i", "at.j", "node", "label", "at.side", "text").repartition("bh", "kind", "i", "j").sortWithinPartitions("bh", "kind", "i", "j")
    return dealt.mapInArrow(_cross(threshold), "node long, pivot long").distinct()


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, th (the text's hash), class_id of every row of (doc_id, th, text)."""
    every = written(docs.mapInArrow(_signatures, "doc_id long, th long, k1 long, k2 long, n_words long, bands array<long>"), "signatures")
    some = every.where("n_words > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc"), F.min_by("th", "doc_id").alias("th"), F.first("n_words").alias("words"), F.first("bands").alias("bands"))
    # Numbers of rows stay what they are once they are written.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "words", F.explode("bands").alias("bh"))
    # Only bands that several nodes share are of use from here on.
    buckets = written(banded.groupBy("bh").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    met = written(dealt_join(banded, buckets, ["bh"], buckets.select("bh", "n"), "node"), "met")
    pairs = written(met.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared")), "pairs")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "th")
    # Joined by a shuffle at every size: the candidates have no bound that would let them be broadcast.
    texts = written(docs.groupBy("doc_id", "th").agg(F.first("text").alias("text")).join(wanted.hint("merge"), ["doc_id", "th"]).select("node", "text"), "texts")

    best = pairs.groupBy("node").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    links = written(verify(best, texts, threshold), "links")
    labels = components(links)
    rest = written(_apart(pairs, labels).join(best, ["node", "pivot"], "left_anti"), "rest")
    links = written(links.unionByName(verify(rest, texts, threshold)), "links")
    labels = components(links)
    links = written(links.unionByName(_met_in_blocks(met, buckets, labels, texts, threshold)), "links")
    labels = components(links)

    members = labels.join(nodes.select("node", "doc"), "node")
    lowest = members.groupBy("label").agg(F.count("*").alias("n"), F.min("doc").alias("class_id"))
    linked = dealt_join(members.select("node", "label"), lowest.select("label", "class_id"), ["label"], lowest.select("label", "n"), "node").select("node", "class_id")
    known = nodes.join(linked, "node", "left").select("k1", "k2", F.coalesce("class_id", "doc").alias("class_id"))
    out = dealt_join(some.select("doc_id", "th", "k1", "k2"), known, ["k1", "k2"], nodes.select("k1", "k2", "n"), "doc_id").select("doc_id", "th", "class_id")
    return out.unionByName(every.where("n_words = 0 OR doc_id IS NULL").select("doc_id", "th", F.col("doc_id").alias("class_id")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the lowest doc_id of its group, itself if alone) of every row."""
    text = F.col("text").cast("string")
    return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")), threshold).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows, with their columns, of one document of each group: the lowest doc_id; rows without doc_id stay."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    gone = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")), threshold)
    gone = gone.where("doc_id <> class_id").select("doc_id", "th").distinct()
    return rows.join(gone, ["doc_id", "th"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
