"""Language-model scores by a gated recurrent network with a class-factored output.

Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z lowered) and one end per text.  Counts of all training tokens
of the corpus come first: chunks of documents send their distinct words once to buckets of hashes and
get the corpus counts back.  The network's vocabulary are the most frequent tokens, `VOCABULARY` times the
fourth root of the number of training tokens, so it grows with the corpus; all others enter and leave it as
one of `FORMS` forms (by their letters).  The output is P(class | state) * P(word | class): classes are runs
of the vocabulary by frequency, about as many as half a class's words, so the softmax grows by the root of
the vocabulary only; and the forms, within which a word's share follows its corpus count (half a count
added, and half for one unknown word of the form).

The weights are fitted by truncated backpropagation in numpy (segments of `SEGMENT` tokens, the state
carried over `CARRIED` windows of a document, so that few long ones don't hold up the rest): first on a bounded seed of documents, from which
all start, then in one pass over all windows of every training document, in shards whose weights are
averaged by windows, in sums of sums.  Shards follow from the documents' contents and the number of training
tokens, never from the cluster's settings.  A text's score is the log10 probability of all its tokens, the
state carried from window to window from its first token to its end.

Defined results: a null or empty text is one end; a corpus without training tokens has N = V = 0 and an
untrained network; very long texts are learnt from and scored whole; rows keep their doc_id, repeated or
null, and repeated rows are learnt from as often; words of equal counts are ordered by their hashes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import chunked, expand, hash_spans, text_buffer, text_column, text_lengths, word_spans
from quern.llm.substrings import _size
from quern.llm.tables import written

#: Words of the vocabulary by the fourth root of the number of training tokens; forms of all others.
VOCABULARY, FORMS = 48, 16
HIDDEN, SEGMENT, WINDOW = 32, 32, 64
#: Documents of the seed, and windows of each of them that it takes.
SEED_ROWS, SEED_WINDOWS, SEED_EPOCHS = 48, 64, 6
RATE, REFINE_RATE, LANES = 0.01, 0.002, 256
#: Windows over which training carries the state; scoring carries it over the whole text.
CARRIED = 64
#: Weights that one block of an Adam step moves.
ADAM = 1 << 15
#: Documents that are scored in step, and tokens whose probabilities are computed at once.
IN_STEP, PENDING = 512, 8_000
#: What stays in a core's cache: bytes of text that are cut into tokens at once, tokens looked up, rows of logits, time steps of gradients; and the runs of equal rows that are summed one by one.
TEXT_BLOCK, ID_BLOCK, ROW_BLOCK, TIME_BLOCK, LONG_RUN = 256 << 10, 1 << 16, 1_024, 4, 32
#: Logits up to this size stay far from what 32 bits hold when exponentiated and summed.
SMALL = 60
CHUNK_TEXT, BUCKET_TEXT = 32 << 20, 512 << 20
#: Training tokens of a shard; the fewest shards; shards (or sums) that one task sums, and the sums that the driver gets.
SHARD_TOKENS, SHARDS, FAN_IN, SUMS = 4 << 20, 8, 32, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The end token's hash; no word has it but by chance.
END = np.uint64(0xE4D0F7E37E57AA11)


def vocabulary(n: int) -> int:
    """Words of the vocabulary of a corpus of n training tokens."""
    return math.ceil(VOCABULARY * n**0.25)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of all texts' tokens, ends included, and the texts' numbers of tokens."""
    ends, at, parts = np.cumsum(text_lengths(texts)), 0, []
    while not parts or at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BLOCK, "right")))
        parts.append(_tokens(texts.slice(at, to - at)))
        at = to
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    data = _LOWER[data]
    starts, stops, doc = word_spans(data, offsets)
    words = hash_spans(data, starts, stops)
    n = len(texts)
    counts = np.bincount(doc, minlength=n)
    # A word's form: by its first byte pair beyond ASCII, else by its last byte.
    high = np.flatnonzero(data[:-8] >= 0xC2)
    at = np.searchsorted(high, starts)
    first = high[np.minimum(at, len(high) - 1)] if len(high) else np.zeros(len(starts), np.int64)
    has = (at < len(high)) & (first < stops) if len(high) else np.zeros(len(starts), bool)
    half = FORMS // 2
    form = np.where(has, half + data[np.minimum(first + 1, len(data) - 1)] % half, data[stops - 1] % half if len(stops) else 0)
    out, kind = np.full(len(words) + n, END), np.zeros(len(words) + n, np.int64)
    place = np.arange(len(words)) + doc
    out[place], kind[place] = words, form
    return out, kind, counts + 1


def _small(weights: np.ndarray, peak: float) -> bool:
    """Can logits of the weights (the last is a bias's) and of states up to peak be exponentiated as they are, without loss?"""
    sizes = np.abs(weights)
    return float((sizes[:, :-1].sum(axis=1) * peak + sizes[:, -1]).max(initial=0)) < SMALL


def _chosen(logits: np.ndarray, choice: np.ndarray, back: bool, small: bool) -> np.ndarray:
    """Log probabilities of each column's choice; with back, logits become their gradients, else they are lost.  small: see _small."""
    columns = np.arange(len(choice))
    if not small:
        logits -= logits.max(axis=0)
    own = logits[choice, columns]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    own -= np.log(total)
    if back:
        logits *= -1 / total
        logits[choice, columns] += 1
    return own


def _run_sums(rows: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each run of order (they begin at edges) the sum of its rows, added one by one: short runs in step, long ones each alone."""
    sizes = np.diff(np.append(edges, len(order)))
    by_size = np.argsort(-sizes, kind="stable")
    begin, sizes = edges[by_size], sizes[by_size]
    long = int(np.searchsorted(-sizes, -LONG_RUN, "left"))
    out = np.empty((len(sizes), rows.shape[1]), rows.dtype)
    for k, (a, n) in enumerate(zip(begin[:long].tolist(), sizes[:long].tolist(), strict=True)):
        np.add.reduce(np.take(rows, order[a : a + n], axis=0), axis=0, out=out[k])
    begin, sizes, short = begin[long:], sizes[long:], out[long:]
    if len(short):
        np.take(rows, order[begin], axis=0, out=short)
        for k, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0]), "left").tolist(), 1):
            short[:n] += np.take(rows, order[begin[:n] + k], axis=0)
    result = np.empty_like(out)
    result[by_size] = out
    return result


class Network:
    """Weights; words 0 .. size-1 are the vocabulary (0: the end), classes of `width` words, then forms."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray | None = None, forms: np.ndarray | None = None):
        """counts: of the vocabulary's words, forms: tokens of each form; with them the output starts as the corpus's frequencies."""
        self.size = len(hashes)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[hashes & np.uint64(len(self.bits) - 1)] = True
        self.width = max(1, round(math.sqrt(2 * self.size)))
        self.groups = -(-self.size // self.width)
        #: Of ids in windows, -1 included.
        self.kind = np.int16 if self.size + FORMS < 1 << 15 else np.int32
        rng = np.random.default_rng(7)
        h, k = HIDDEN, self.size
        self.w = {
            "x": (rng.normal(size=(k + FORMS, 3 * h)) * 0.1).astype(np.float32), "u": (rng.normal(size=(h, 3 * h)) * h**-0.5).astype(np.float32),
            "c": np.zeros((h, self.groups + FORMS), np.float32), "cb": np.zeros(self.groups + FORMS, np.float32), "v": np.zeros((k, h), np.float32), "vb": np.zeros(k, np.float32),
        }
        if counts is not None:
            self.w["vb"][:] = np.log(counts + 0.5)
            mass = np.concatenate([np.bincount(np.arange(k) // self.width, counts, minlength=self.groups), forms])
            self.w["cb"][:] = np.log((mass + 0.5) / (mass + 0.5).sum())

    def ids(self, hashes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        out = self.size + forms
        for begin in range(0, len(out), ID_BLOCK):
            part = hashes[begin : begin + ID_BLOCK]
            near = np.flatnonzero(self.bits[part & np.uint64(len(self.bits) - 1)])
            part = part[near]
            at = np.minimum(np.searchsorted(self.sorted, part), self.size - 1)
            hit = self.sorted[at] == part
            out[begin + near[hit]] = self.order[at[hit]]
        return out

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.size, ids // self.width, self.groups + ids - self.size)

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and recurrent weights by gate, for step: halved where a gate is (1 + tanh(x / 2)) / 2, which is exact."""
        x, u = (np.ascontiguousarray(self.w[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "xu")
        x[:2] *= 0.5
        u *= 0.5
        return x, u

    def step(self, h: np.ndarray, ids: np.ndarray, gates: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The next states; gates: what _gates gives, if many steps follow."""
        gates = gates or self._gates()
        g, a = np.take(gates[0], ids, axis=1), h @ gates[1]
        zr, m, out = g[:2], g[2], a[2]
        zr += a[:2]
        np.tanh(zr, out=zr)
        zr += 1
        out *= zr[1]
        m += out
        np.tanh(m, out=m)
        np.subtract(h, m, out=out)
        out *= zr[0]
        out *= 0.5
        out += m
        return out

    def output(self, states: np.ndarray, ids: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of P(class | state), times P(word | class) in the vocabulary; with grad, gradients of their sum.

        Logits lie choices x rows, so that sums over choices add whole rows; a last state of 1 carries the biases."""
        w, cls, kind, width, back = self.w, self.classes(ids), states.dtype, self.width, grad is not None
        s = np.ones((len(ids), HIDDEN + 1), kind)
        s[:, :-1] = states
        peak = float(np.abs(states).max(initial=0))
        out, outer = np.empty(len(ids), kind), np.empty_like(states) if back else None
        down = w["c"].T
        weights = np.concatenate([down, w["cb"][:, None]], axis=1)
        small = _small(weights, peak)
        # Rows go in blocks whose logits stay in a core's cache.
        for a in range(0, len(ids), ROW_BLOCK):
            b = a + ROW_BLOCK
            logits = weights @ s[a:b].T
            out[a:b] = _chosen(logits, cls[a:b], back, small)
            if back:
                sums = logits @ s[a:b]
                grad["c"] += sums[:, :-1].T
                grad["cb"] += sums[:, -1]
                np.matmul(logits.T, down, out=outer[a:b])
        # The last class is filled up with words of no probability.
        words = np.zeros((self.groups * width, HIDDEN + 1), kind)
        words[: self.size, :-1], words[: self.size, -1], words[self.size :, -1] = w["v"], w["vb"], -1e30
        small = _small(words[: self.size], peak)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.groups + 1))
        order = order[: edges[-1]]
        s, choice = np.take(s, order, axis=0), np.take(ids, order) % width
        own, inner = np.empty(len(order), kind), np.empty((len(order), HIDDEN), kind)
        sums = np.zeros_like(words) if back else None
        spans = [(c * width, (c + 1) * width, int(edges[c]), int(edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]
        while spans:
            # Whole classes, until a block is full.
            first = spans[0][2]
            count = next((k for k, span in enumerate(spans, 1) if span[3] - first >= ROW_BLOCK), len(spans))
            block, spans = spans[:count], spans[count:]
            last = block[-1][3]
            logits = np.empty((width, last - first), kind)
            for lo, hi, a, b in block:
                np.matmul(words[lo:hi], s[a:b].T, out=logits[:, a - first : b - first])
            own[first:last] = _chosen(logits, choice[first:last], back, small)
            for lo, hi, a, b in block if back else ():
                np.matmul(logits[:, a - first : b - first], s[a:b], out=sums[lo:hi])
                np.matmul(logits[:, a - first : b - first].T, words[lo:hi, :-1], out=inner[a:b])
        out[order] += own
        if back:
            grad["v"] += sums[: self.size, :-1]
            grad["vb"] += sums[: self.size, -1]
            outer[order] += inner
        return out, outer

    def learn(self, windows: np.ndarray, fresh: np.ndarray, rate: float, epochs: int, lanes: int = LANES) -> None:
        """Adam steps on windows (n x WINDOW + 1 ids, -1 after the end), by segments with the state carried up to the next fresh window."""
        # Weights, gradients and moments are moved in blocks that stay in a core's cache.
        flat = self.flat()
        self.w, sums = self._split(flat), np.empty_like(flat)
        blocks = [tuple(x[a : a + ADAM] for x in (flat, sums, *moments)) for moments in [(np.zeros_like(flat), np.zeros_like(flat))] for a in range(0, len(flat), ADAM)]
        steps = 0
        rng = np.random.default_rng(11)
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, len(windows)))
        for _ in range(epochs):
            # Each lane reads runs of windows one after another; the next run goes to the shortest lane, long ones first.
            heap, queues = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
            runs = rng.permutation(len(begins))
            for run in runs[np.argsort(sizes[runs] < WINDOW // 2, kind="stable")]:
                size, k = heap[0]
                queues[k].append(np.arange(begins[run], begins[run] + sizes[run]))
                heapq.heapreplace(heap, (size + int(sizes[run]), k))
            queues = sorted((np.concatenate(q) for q in queues if q), key=len, reverse=True)
            h = np.zeros((len(queues), HIDDEN), np.float32)
            for at in range(len(queues[0]) if queues else 0):
                now = np.array([q[at] for q in queues if len(q) > at])
                batch = windows[now].astype(np.int64)
                h = np.where(fresh[now][:, None], np.float32(0), h[: len(now)])
                for begin in range(0, WINDOW, SEGMENT):
                    part = batch[:, begin : begin + SEGMENT + 1]
                    if not (part[:, 1] >= 0).any():
                        break
                    _, h = self._segment(part, h, sums)
                    steps += 1
                    # Few lanes that are left move the weights less.
                    size, root = rate * math.sqrt(len(now) / len(queues)) / (1 - 0.9**steps), math.sqrt(1 - 0.99**steps)
                    # a and b: 10 and 100 times the moments; the gradient's place is free once a has it.
                    for w, g, a, b in blocks:
                        a *= 0.9
                        a += g
                        g *= g
                        b *= 0.99
                        b += g
                        np.sqrt(b, out=g)
                        g += 1e-7 * root
                        np.divide(a, g, out=g)
                        g *= size * root
                        w += g

    def _segment(self, part: np.ndarray, h: np.ndarray, flat: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
        """Gradients (in flat, if given) of the mean log likelihood of part's ids (after the first) from states h, and the last states."""
        w, n, size, hid = self.w, len(part), part.shape[1] - 1, HIDDEN
        kind = w["x"].dtype
        flat = np.empty(sum(v.size for v in w.values()), kind) if flat is None else flat
        flat.fill(0)
        grad = self._split(flat)
        used = np.maximum(part[:, :-1].T, 0)
        # Of gate (z, r, m), time and text: what one step works on lies together.
        x, u = (np.ascontiguousarray(w[k].reshape(-1, 3, hid).transpose(1, 0, 2)) for k in "xu")
        # Gates are (1 + tanh(x / 2)) / 2; halving is exact.
        x[:2] *= 0.5
        u[:2] *= 0.5
        gates = np.take(x, used, axis=1)
        states, inner = np.empty((size + 1, n, hid), kind), np.empty((size, n, hid), kind)
        states[0] = h
        a, step = np.empty((3, n, hid), kind), np.empty((n, hid), kind)
        for t in range(size):
            np.matmul(states[t], u, out=a)
            zr, m = gates[:2, t], gates[2, t]
            zr += a[:2]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            inner[t] = a[2]
            m += np.multiply(zr[1], a[2], out=step)
            np.tanh(m, out=m)
            np.subtract(states[t], m, out=step)
            step *= zr[0]
            np.add(step, m, out=states[t + 1])
        wanted = part[:, 1:].T
        live = wanted >= 0
        count = max(int(live.sum()), 1)
        # np.take copies whole rows, which indexing does not.
        at = np.flatnonzero(live)
        after, wanted = states[1:].reshape(-1, hid), wanted.ravel()
        some = len(at) < wanted.size
        _, outer = self.output(np.take(after, at, axis=0) if some else after, np.take(wanted, at) if some else wanted, grad)
        if some:
            back, outer = outer, np.zeros_like(after)
            outer[at] = back
        outer = outer.reshape(size, n, hid)
        d, down = np.zeros((n, hid), kind), np.ascontiguousarray(w["u"].T)
        into, middle = np.empty((size, n, 3 * hid), kind), np.empty_like(inner)
        for t in range(size - 1, -1, -1):
            z, r, m, row, dm = *gates[:, t], into[t], middle[t]
            d += outer[t]
            # m' = 1 - m^2; z' = z (1 - z); r' = r (1 - r)
            kept = np.multiply(d, z, out=step)
            d -= kept
            np.multiply(m, m, out=dm)
            np.subtract(1, dm, out=dm)
            dm *= d
            d *= z
            np.subtract(states[t], m, out=m)
            np.multiply(d, m, out=row[:, :hid])
            through = np.multiply(dm, r, out=m)
            row[:, 2 * hid :] = through
            through *= inner[t]
            np.subtract(1, r, out=r)
            np.multiply(through, r, out=row[:, hid : 2 * hid])
            np.matmul(row, down, out=d)
            d += kept
            if t % TIME_BLOCK == 0:
                block = slice(t, t + TIME_BLOCK)
                grad["u"] += states[:-1][block].reshape(-1, hid).T @ into[block].reshape(-1, 3 * hid)
                into[block, :, 2 * hid :] = middle[block]
        used = used.astype(self.kind).ravel()
        order = np.argsort(used, kind="stable")
        rows, edges = np.unique(used[order], return_index=True)
        grad["x"][rows] = _run_sums(into.reshape(-1, 3 * hid), order, edges)
        flat *= 1 / max(math.sqrt(float(np.vdot(flat, flat))), count)
        return grad, states[-1]

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def _split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of flat in the shapes of the weights."""
        ends = np.cumsum([v.size for v in self.w.values()])
        return {k: flat[b - v.size : b].reshape(v.shape) for (k, v), b in zip(self.w.items(), ends, strict=True)}

    def set_flat(self, values: np.ndarray) -> None:
        self.w = self._split(values.astype(np.float32))

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the network's part of each document's probability; documents of like length go in step, so many that their states stay in a core's cache."""
        order = np.argsort(-counts, kind="stable")
        size, first = counts[order], (np.cumsum(counts) - counts)[order]
        out, gates = np.zeros(len(counts)), self._gates()
        states, wanted, rows, pending = [], [], [], 0
        for lo in range(0, len(counts), IN_STEP):
            hi = min(lo + IN_STEP, len(counts))
            longest, begin = int(size[lo]), first[lo:hi]
            active = np.searchsorted(-size[lo:hi], -np.arange(longest), "left").tolist()
            h, last = np.zeros((hi - lo, HIDDEN), np.float32), np.zeros(hi - lo, np.int64)
            for t, m in enumerate(active):
                h = self.step(h[:m], last[:m], gates)
                last = ids[begin[:m] + t]
                states.append(h)
                wanted.append(last)
                rows.append((lo, m))
                pending += m
                if pending > PENDING:
                    self._added(out, states, wanted, rows)
                    states, wanted, rows, pending = [], [], [], 0
        if rows:
            self._added(out, states, wanted, rows)
        result = np.empty(len(counts))
        result[order] = out / math.log(10)
        return result

    def _added(self, out: np.ndarray, states: list, wanted: list, rows: list) -> None:
        got, begin = self.output(np.concatenate(states), np.concatenate(wanted))[0], 0
        for lo, m in rows:
            out[lo : lo + m] += got[begin : begin + m]
            begin += m


def _held(mod: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def _bool(batch, name: str) -> np.ndarray:
    return batch.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def _counted(buckets: int):
    """A chunk's distinct words with their training counts, dealt into buckets."""

    def run(key, table):
        batch = table.combine_chunks()
        hashes, forms, counts = tokens(text_column(batch.to_batches()[0], "text"))
        train = np.repeat(~_bool(batch, "held_out"), counts)
        words = pa.array(hashes).dictionary_encode()
        found, number = words.dictionary.to_numpy(), words.indices.to_numpy()
        # Words are numbered as they first occur.
        first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
        times = np.bincount(number[train], minlength=len(found)).astype(np.int64)
        bucket = ((found >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, times, form, bucket = found[order], times[order], forms[first][order].astype(np.uint8), bucket[order]
        names, at = np.unique(bucket, return_index=True)
        ends = np.append(at, len(bucket))[1:]
        told = {"bucket": pa.array(names.astype(np.int32)), "chunk": pa.array(np.full(len(names), key[0].as_py())), "tokens": pa.array(np.full(len(names), int(train.sum())))}
        return pa.table({**told, **{n: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for n, x in (("hashes", found), ("times", times), ("forms", form))}})

    return run


def _totals(buckets: int):
    """For each chunk its words' corpus counts; and one row (chunk -1) with the bucket's most frequent words and its forms' tokens and words."""

    def run(table):
        chunks = table.column("chunk").to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        hashes, times = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("times").to_pylist()])
        forms = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("forms").to_pylist()])
        found, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        number = number.ravel()
        total = np.bincount(number, times, minlength=len(found)).astype(np.int64)
        known, form = total > 0, forms[first]
        sums = [np.bincount(form[known], total[known], minlength=FORMS).astype(np.int64).tolist(), np.bincount(form[known], minlength=FORMS).tolist()]
        # Hashes deal words evenly, so a bucket has about wanted / buckets of the most frequent; it names four times as many and 32.
        # Chunks without a word here go uncounted: even were they 255 of 256, the fourth root would leave no fewer than a quarter.
        wanted = vocabulary(sum(table.column("tokens").to_pylist()))
        top = np.lexsort((found, -total))[: min(wanted, 4 * wanted // buckets + 32)]
        top = top[total[top] > 0]
        ends = np.cumsum([len(p) for p in parts])
        reply = [total[number[b - len(p) : b]].tobytes() for b, p in zip(ends, parts, strict=True)]
        n = len(chunks)
        return pa.table({
            "chunk": pa.array(np.append(chunks, -1)), "hashes": pa.array([*(p.tobytes() for p in parts), b""], pa.binary()), "counts": pa.array([*reply, b""], pa.binary()),
            "top": pa.array([None] * n + [[{"hash": int(a), "count": int(b), "form": int(f)} for a, b, f in zip(found[top].view(np.int64), total[top], form[top], strict=True)]], pa.list_(pa.struct([("hash", pa.int64()), ("count", pa.int64()), ("form", pa.int32())]))),
            "sums": pa.array([None] * n + [sums], pa.list_(pa.list_(pa.int64()))),
        })

    return run


def _windows(shared):
    """All training tokens in consecutive windows, a document a row."""

    def run(batches):
        network: Network = shared.value
        for batch in chunked(batches):
            hashes, forms, counts = tokens(text_column(batch, "text"))
            rows = windows_of(network.ids(hashes, forms), counts, network.kind)
            ends = np.cumsum(-(-counts // WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array([rows[a:b].tobytes() for a, b in zip(np.append(0, ends), ends, strict=False)], pa.binary())], ["windows"])

    return run


def windows_of(ids: np.ndarray, counts: np.ndarray, kind: type = np.int16) -> np.ndarray:
    """Each document's windows (the token before, 0 at its start, then WINDOW ids, -1 after the end)."""
    number = -(-counts // WINDOW)
    doc = np.repeat(np.arange(len(counts)), number)
    begin = (np.arange(len(doc)) - (np.cumsum(number) - number)[doc]) * WINDOW
    at = begin[:, None] - 1 + np.arange(WINDOW + 1)
    first = np.cumsum(counts) - counts
    out = np.where(at < counts[doc][:, None], ids[np.clip(first[doc][:, None] + at, 0, len(ids) - 1)], -1)
    out[at < 0] = 0
    return out.astype(kind)


def _read(rows: list[bytes], kind: type = np.int16) -> tuple[np.ndarray, np.ndarray]:
    """The rows' windows, and which of them begin without a state: a document's first, and every CARRIED-th after it."""
    windows = np.frombuffer(b"".join(rows), kind).reshape(-1, WINDOW + 1)
    sizes = np.array([len(r) // (np.dtype(kind).itemsize * (WINDOW + 1)) for r in rows])
    return windows, expand(sizes)[1] % CARRIED == 0


def _refined(shared):
    """A shard's weights after one pass over its windows, and their number."""

    def run(key, table):
        # A worker keeps its broadcast values: learn on a copy.  The order of rows is that of their contents.
        network: Network = copy.deepcopy(shared.value)
        windows, fresh = _read(sorted(table.column("windows").to_pylist()), network.kind)
        network.learn(windows, fresh, REFINE_RATE, 1)
        return pa.table({"shard": pa.array([key[0].as_py()]), "weights": pa.array([network.flat().astype(np.float32).tobytes()], pa.binary()), "n": pa.array([len(windows)], pa.int64())})

    return run


def _summed(key, table):
    """The mean of weights by their numbers of windows; summed in order of shards."""
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("weights").to_pylist(), table.column("n").to_pylist(), strict=True))
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for _, x, n in rows)
    n = sum(r[2] for r in rows)
    return pa.table({"shard": pa.array([key[0].as_py()]), "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def _scored(shared):
    def run(key, table, verdict):
        network, spread, n_all, v_all = shared.value
        batch = table.combine_chunks()
        hashes, forms, counts = tokens(text_column(batch.to_batches()[0], "text"))
        known = np.frombuffer(b"".join(verdict.column("hashes").to_pylist()), np.uint64)
        times = np.frombuffer(b"".join(verdict.column("counts").to_pylist()), np.int64)
        c = times[pc.index_in(pa.array(hashes), pa.array(known)).to_numpy()]
        doc, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        base = np.bincount(doc, np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1))), minlength=n)
        ids = network.ids(hashes, forms)
        score = network.score(ids, counts)
        rare = ids >= network.size
        score += np.bincount(doc[rare], np.log10((c[rare] + 0.5) / spread[ids[rare] - network.size]), minlength=n)
        return pa.table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(counts), "n_known": pa.array(np.bincount(doc[c > 0], minlength=n)), "train_tokens": pa.array(np.full(n, n_all)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, size = int(spark.conf.get("spark.sql.shuffle.partitions")), _size(docs)
    chunks, buckets = max(parts, size // CHUNK_TEXT), max(parts, size // BUCKET_TEXT)
    docs = docs.withColumn("held_out", _held(folds, held_out))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    sent = dealt.groupBy("chunk").applyInArrow(_counted(buckets), "bucket int, chunk long, tokens long, hashes binary, times binary, forms binary")
    told = written(sent.groupBy("bucket").applyInArrow(_totals(buckets), "chunk long, hashes binary, counts binary, top array<struct<hash:long,count:long,form:int>>, sums array<array<long>>"), "counts")
    sums = told.where("sums IS NOT NULL").select(F.posexplode("sums").alias("kind", "s")).select("kind", F.posexplode("s").alias("form", "n")).groupBy("kind", "form").agg(F.sum("n").alias("n")).collect()
    by = {(r["kind"], r["form"]): r["n"] for r in sums}
    n_form, v_form = (np.array([by.get((k, f), 0) for f in range(FORMS)], np.float64) for k in (0, 1))
    n_all, v_all = int(n_form.sum()), int(v_form.sum())
    top = [tuple(r) for r in told.where("top IS NOT NULL").select(F.explode("top").alias("t")).select("t.hash", "t.count", "t.form").orderBy(F.desc("count"), "hash").limit(vocabulary(n_all)).collect()]
    end = int(END.astype(np.int64)) if END < np.uint64(1 << 63) else int(END) - (1 << 64)
    inner = [t for t in top if t[0] != end]
    for _, c, f in top:
        n_form[f] -= c
        v_form[f] -= 1
    ends = sum(c for h, c, _ in top if h == end)
    network = Network(np.array([end, *(t[0] for t in inner)], np.int64).view(np.uint64), np.array([ends, *(t[1] for t in inner)], np.float64), np.maximum(n_form, 0))
    spread = np.maximum(n_form, 0) + 0.5 * (np.maximum(v_form, 0) + 1)
    windows = written(docs.where("NOT held_out").mapInArrow(_windows(spark.sparkContext.broadcast(network)), "windows binary"), "windows")
    seed = [r[0] for r in windows.orderBy(F.xxhash64("windows"), "windows").limit(SEED_ROWS).select(F.substring("windows", 1, SEED_WINDOWS * (WINDOW + 1) * np.dtype(network.kind).itemsize)).collect()]
    if seed:
        network.learn(*_read([bytes(r) for r in seed], network.kind), RATE, SEED_EPOCHS)
        shards = max(SHARDS, -(-n_all // SHARD_TOKENS))
        kind = "shard long, weights binary, n long"
        found = windows.withColumn("shard", F.pmod(F.xxhash64("windows"), F.lit(shards))).groupBy("shard").applyInArrow(_refined(spark.sparkContext.broadcast(network)), kind)
        while shards > SUMS:
            shards = max(SUMS, -(-shards // FAN_IN))
            found = found.withColumn("to", F.pmod("shard", F.lit(shards))).groupBy("to").applyInArrow(_summed, kind)
        merged = sorted(map(tuple, found.collect()))
        network.set_flat(sum(np.frombuffer(r[1], np.float32).astype(np.float64) * r[2] for r in merged) / sum(r[2] for r in merged))
    shared = spark.sparkContext.broadcast((network, spread, n_all, v_all))
    return dealt.groupBy("chunk").cogroup(told.where("chunk >= 0").select("chunk", "hashes", "counts").groupBy("chunk")).applyInArrow(_scored(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
