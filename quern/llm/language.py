"""Language identification of code-switched text by a linear-chain conditional random field.

Words (runs of letters, with A-Z and U+00C0 to U+00DE lower-cased) are labelled with languages.  A word's
potentials come from its affixes (one to three bytes at either end), its two- and three-byte grams and
itself (a lexicon), all hashed into one table; neighbouring labels have learnt transition potentials.
Weights are fitted in numpy by gradient steps on the exact likelihood, over every word of the training
texts: they are cut into sequences, and a third of these swap their second halves with a sequence of
another language, so that transitions learn changes inside a text as well.  A document's words get posterior
probabilities by forward-backward over the whole text: blocks of words are reduced to transfer matrices,
messages pass from block to block, and then into all blocks at once, so a very long text costs no more per
word.  The predicted language has the largest share of the words' posterior probability; that is the score.

The fit uses at most `train_rows` documents, the same number of each language (those with the smallest hash
of doc_id), one at least of each; predictions read every word of every text.

Defined results: a null text or one without a letter is `und` with score 0; without training rows so
is every text; ties go to the first language in order; of several texts of a doc_id in one language the fit
takes that of the lowest hash; repeated rows are predicted alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm.common import chunked, hash_spans, mix, text_buffer, text_column, word_spans

TRAIN_ROWS = 1600
#: Words of a training sequence, sequences of a gradient step, and the share of sequences that swap halves.
SEQUENCE, STEP, SWITCHED = 60, 4096, 1 / 3
TABLE = 1 << 16
EPOCHS, RATE, DECAY = 12, 0.3, 1e-4
#: Words of a block of the chain.
BLOCK = 32

_OTHER = np.zeros(256, bool)
_OTHER[:128] = [not chr(c).isalpha() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the words' starts, ends and documents."""
    data, offsets = text_buffer(texts)
    data = _LOWER[data]
    # Capitals of U+00C0 to U+00DE have their small letters 32 further on.
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = (data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)
    data[after[capital]] += 32
    return data, *word_spans(data, offsets, _OTHER)


def _features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot of the table) of every feature of the words; slots of one word may repeat."""
    length = stops - starts
    n = len(starts)
    slot = [(words ^ np.uint64(0x1234567)).astype(np.uint64)]
    owner = [np.arange(n)]
    d = data.astype(np.uint64)
    for size in (1, 2, 3):
        have = np.flatnonzero(length >= size)
        for kind, begin in ((size, starts[have]), (size + 3, stops[have] - size)):
            key = np.full(len(have), kind, np.uint64)
            for k in range(size):
                key = key * np.uint64(257) + d[begin + k] + np.uint64(1)
            owner.append(have)
            slot.append(key)
    for size in (2, 3):
        count = np.maximum(length - size + 1, 0)
        which = np.repeat(np.arange(n), count)
        at = starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        key = np.full(len(which), size + 7, np.uint64)
        for k in range(size):
            key = key * np.uint64(257) + d[at + k] + np.uint64(1)
        owner.append(which)
        slot.append(key)
    return np.concatenate(owner), (mix(np.concatenate(slot)) % np.uint64(TABLE)).astype(np.int64)


def _types(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Documents of the words, their distinct words' numbers, and those words' features."""
    data, starts, stops, doc = _letters(texts)
    words = hash_spans(data, starts, stops)
    kinds, first, number = np.unique(words, return_index=True, return_inverse=True)
    owner, slot = _features(data, starts[first], stops[first], kinds)
    return doc, number.ravel(), owner, slot, len(kinds)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=-1, keepdims=True)


def sequences(doc: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, place in it and language of every word; a sequence's words follow each other in the same order as before.
    Words of documents are cut into sequences of SEQUENCE; some pairs of different languages swap their second halves."""
    counts = np.bincount(doc, minlength=len(labels))
    place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    per = -(-counts // SEQUENCE)
    own = (np.cumsum(per) - per)[doc] + place // SEQUENCE
    language = np.repeat(labels, per)
    order = np.random.default_rng(3).permutation(len(language))[: int(len(language) * SWITCHED)]
    a, b = order[0 : len(order) // 2 * 2 : 2], order[1::2]
    other = np.arange(len(language))
    differ = language[a] != language[b]
    other[a[differ]], other[b[differ]] = b[differ], a[differ]
    # Both sequences of a pair are longer than a half, or nothing is swapped.
    size = np.bincount(own, minlength=len(language))
    half = SEQUENCE // 2
    other = np.where((size > half) & (size[other] > half), other, np.arange(len(language)))
    late = place % SEQUENCE >= half
    return np.where(late, other[own], own), place % SEQUENCE, labels[doc]


class Chain:
    """The field: languages, the table of potentials and the transitions (in logarithms)."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.table = np.zeros((TABLE, k), np.float32)
        self.moves = np.eye(k) * 2.0

    def scores(self, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, self.table[slot, k], minlength=n) for k in range(len(self.languages))], 1) if n else np.zeros((0, len(self.languages)))

    def fit(self, texts: list[str], labels: list[int]) -> None:
        doc, number, owner, slot, kinds = _types(pa.array(texts, pa.large_string()))
        if not len(doc):
            return
        sequence, column, gold = sequences(doc, np.array(labels))
        order = np.lexsort((column, sequence))
        sequence, column, gold, number = sequence[order], column[order], gold[order], number[order]
        k, moves2, table2 = len(self.languages), np.full((len(self.languages),) * 2, 1e-6), np.full((TABLE, len(self.languages)), 1e-6)
        for _ in range(EPOCHS):
            for begin in range(0, int(sequence.max()) + 1, STEP):
                now = np.flatnonzero((sequence >= begin) & (sequence < begin + STEP))
                if not len(now):
                    continue
                emission = self.scores(owner, slot, kinds)[number[now]]
                posterior, pairs = self.expected(sequence[now] - begin, column[now], emission)
                gap = -posterior
                gap[np.arange(len(now)), gold[now]] += 1
                by_kind = np.stack([np.bincount(number[now], gap[:, j], minlength=kinds) for j in range(k)], 1)
                step = np.stack([np.bincount(slot, by_kind[owner, j], minlength=TABLE) for j in range(k)], 1) / STEP - DECAY * self.table
                table2 += step**2
                self.table += (RATE * step / np.sqrt(table2)).astype(np.float32)
                # Neighbours as they are, and a first word after any language alike.
                seen, inner = np.zeros((k, k)), np.flatnonzero(column[now] > 0)
                np.add.at(seen, (gold[now[inner] - 1], gold[now[inner]]), 1)
                seen += np.bincount(gold[now][column[now] == 0], minlength=k)[None, :] / k
                step = (seen - pairs) / len(now) - DECAY * self.moves
                moves2 += step**2
                self.moves += RATE * step / np.sqrt(moves2)

    def expected(self, sequence: np.ndarray, column: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior probabilities of the words' labels, and the expected number of each pair of neighbouring labels."""
        k, n, width = len(self.languages), int(sequence.max()) + 1, int(column.max()) + 1
        phi, mask = np.ones((width, n, k)), np.zeros((width, n, 1), bool)
        phi[column, sequence] = np.exp(emission - emission.max(axis=1, keepdims=True))
        mask[column, sequence] = True
        a = np.exp(self.moves)
        f = np.empty((width + 1, n, k))
        f[0] = 1 / k
        for t in range(width):
            f[t + 1] = np.where(mask[t], _scaled((f[t] @ a) * phi[t]), f[t])
        b = np.ones((n, k))
        posterior, pairs = np.empty((width, n, k)), np.zeros((k, k))
        for t in range(width - 1, -1, -1):
            p = f[t + 1] * b
            posterior[t] = p / p.sum(axis=1, keepdims=True)
            joint = f[t][:, :, None] * a[None] * (phi[t] * b)[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * mask[t][:, :, None]).sum(axis=0)
            b = np.where(mask[t], _scaled((phi[t] * b) @ a.T), b)
        return posterior[column, sequence], pairs

    def shares(self, texts: pa.Array) -> np.ndarray:
        """Each document's share of posterior probability of each language; zeros without words."""
        doc, number, owner, slot, kinds = _types(texts)
        k, n = len(self.languages), len(texts)
        out = np.zeros((n, k))
        if not len(doc):
            return out
        emission = self.scores(owner, slot, kinds)
        phi = np.exp(emission - emission.max(axis=1, keepdims=True))[number]
        counts = np.bincount(doc, minlength=n)
        first = np.cumsum(counts) - counts
        per = -(-counts // BLOCK)
        block_doc = np.repeat(np.arange(n), per)
        rank = np.arange(len(block_doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[block_doc] + rank * BLOCK
        size = np.minimum(counts[block_doc] - rank * BLOCK, BLOCK)
        blocks = len(begin)
        a = np.exp(self.moves)
        part = np.ones((BLOCK, blocks, k))
        for t in range(BLOCK):
            live = np.flatnonzero(size > t)
            part[t, live] = phi[begin[live] + t]
        matrix = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(BLOCK):
            live = slice(None) if (size > t).all() else np.flatnonzero(size > t)
            m = (matrix[live].reshape(-1, k) @ a).reshape(-1, k, k) * part[t, live][:, None, :]
            matrix[live] = m / m.max(axis=(1, 2), keepdims=True)
        into, onto = np.full((blocks, k), 1.0 / k), np.ones((blocks, k))
        start = np.cumsum(per) - per
        for r in range(1, int(per.max())):
            here = start[per > r] + r
            into[here] = _scaled(np.einsum("bi,bij->bj", into[here - 1], matrix[here - 1]))
        for r in range(int(per.max()) - 2, -1, -1):
            here = start[per > r + 1] + r
            onto[here] = _scaled(np.einsum("bij,bj->bi", matrix[here + 1], onto[here + 1]))
        f = np.empty((BLOCK, blocks, k))
        now = into
        for t in range(BLOCK):
            now = np.where((size > t)[:, None], _scaled((now @ a) * part[t]), now)
            f[t] = now
        total, b = np.zeros((blocks, k)), onto
        for t in range(BLOCK - 1, -1, -1):
            live = (size > t)[:, None]
            p = f[t] * b
            total += np.where(live, p / p.sum(axis=1, keepdims=True), 0)
            b = np.where(live, _scaled((part[t] * b) @ a.T), b)
        for j in range(k):
            out[:, j] = np.bincount(block_doc, total[:, j], minlength=n)
        return out / np.maximum(counts, 1)[:, None]


def _fitted(batches):
    """One task's training rows, in order, to a chain's arrays."""
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
    languages = sorted({r[1] for r in rows})
    chain, out = Chain(languages), io.BytesIO()
    chain.fit([r[2] for r in rows], [languages.index(r[1]) for r in rows])
    np.savez(out, table=chain.table, moves=chain.moves)
    yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), pa.array([out.getvalue()], pa.binary())], ["languages", "chain"])


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> Chain:
    """A chain from documents outside the held-out fold (crc32 of doc_id) with a language, fitted in one task; the driver gets its arrays only."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    usable = docs.where((fold != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, train_rows // max(1, sizes.count()))
    # Of a language's rows those of the smallest hashes, twice as many as needed, are ranked.
    number = F.xxhash64("_id")
    near = usable.select("_id", "lang").join(sizes, "lang").where(F.pmod(number, F.lit(1 << 20)) * F.col("n") <= F.lit(2 * each << 20)).select("_id", "lang").distinct()
    chosen = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(number, F.lit(1 << 20)), "_id"))).where(F.col("_n") <= each).drop("_n")
    rows = usable.join(F.broadcast(chosen), ["_id", "lang"]).groupBy("_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.coalesce(1).mapInArrow(_fitted, "languages array<string>, chain binary").collect()
    chain = Chain(list(found[0][0]) if found else [])
    if found and chain.languages:
        with np.load(io.BytesIO(bytes(found[0][1]))) as arrays:
            chain.table, chain.moves = arrays["table"], arrays["moves"]
    return chain


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        found: Chain = shared.value
        for batch in chunked(batches):
            texts = text_column(batch, "text")
            shares = found.shares(texts) if found.languages else np.zeros((batch.num_rows, 1))
            best = shares.argmax(axis=1)
            top = np.round(shares.max(axis=1), 9).clip(0, 1)
            unsure = shares.sum(axis=1) <= 0
            # Bytes beyond ASCII count as letters above; where nothing else does, ask what they are.
            plain = _ASCII_LETTER
            data, offsets = text_buffer(texts)
            letters = np.concatenate([[0], np.cumsum(plain[data[:-8]])])
            for d in np.flatnonzero(~unsure & (letters[offsets[1:]] == letters[offsets[:-1]])):
                unsure[d] = not any(c.isalpha() for c in texts[int(d)].as_py())
            names = ["und" if u else found.languages[k] for u, k in zip(unsure, best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(names, pa.string()), pa.array(np.where(unsure, 0.0, top))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


_ASCII_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return predict(docs, fit(docs, folds, held_out)).select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
