"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary tokens.  The cut is the BPE result
exactly when no adjacent pair of its tokens would have been merged differently across their
border; that is tested for all pairs of a whole batch of words at once, by undoing merges in
numpy until a pair is proved or refuted.  Only words with a refuted pair are merged exactly.

The vocabulary is a tokenizers-library file with an NFC + lower-case normalizer, a splitting
pattern, byte-level symbols and a word-end suffix; its bytes are read once on the driver and
broadcast (a fixed file of about 2 MB).  White space never lies in a token, so texts are cut at
ASCII white space (the pattern cuts the rest) and every distinct piece is encoded once per chunk; a
bounded dictionary per worker keeps pieces, at its bound those that came again, and goes when another
stage begins in the worker.  Texts are cut, and their pieces' ids and tokens joined, as Arrow arrays.

Defined results: a null or empty text has no tokens and decodes to the empty text; very long
texts and words are encoded whole; special tokens' strings in a text are those tokens.  Rows keep
their doc_id, repeated or null; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import HELD, chunked, expand, sha256_hex, text_column

#: Pieces that a worker's dictionary holds at most before it leaves out those that came in one chunk only.
CACHE_PIECES = 300_000
#: Bytes of text that are encoded at once.
CHUNK_TEXT = 4 << 20
#: Symbols of a word above which its exact merging uses a heap instead of rows in step.
LONG_WORD = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        size = max(self.names) + 1
        self.size = size
        #: The merge that made each token: its rank (-1: a symbol) and its two parts.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), (r, t) in self.rank.items():
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        #: Symbols of words are one character each, the word's end is \0; tokens likewise.
        end = self.suffix
        self.tokens = {(t[: -len(end)] + "\0" if end and t.endswith(end) else t): i for t, i in self.ids.items()}
        self.merge_to = np.array([t for _, t in self.rank.values()], np.int64)
        self._trie()
        #: The strings of ids and tokens, by id.
        text = [self.names.get(i, "") for i in range(size)]
        self.digits, self.shown = pa.array(list(map(str, range(size))), pa.large_string()), pa.array(text, pa.large_string())
        #: Numbers of the known pieces; of each number its ids as text, its number of tokens, and its tokens as text.
        self.pieces: dict[str, int] = {}
        self.ids_of = self.tokens_of = pa.array([], pa.large_string())
        self.count_of = np.zeros(0, np.int64)
        #: Pieces that were in the dictionary already when they came.
        self.again: set[str] = set()

    def _trie(self) -> None:
        """Nodes are the tokens' prefixes; edges are sorted node * 257 + symbol, symbol 256 being a word's end."""
        codes = {c: b for b, c in self.symbols.items()} | {"\0": 256}
        nodes, edges, accept = {"": 0}, [], {}
        for token, i in self.tokens.items():
            for k in range(len(token)):
                if token[: k + 1] not in nodes:
                    nodes[token[: k + 1]] = len(nodes)
                    edges.append((nodes[token[:k]] * 257 + codes[token[k]], nodes[token[: k + 1]]))
            accept[nodes[token]] = i
        edges.sort()
        self.edge_keys, self.edge_to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.accept = np.full(len(nodes), -1, np.int64)
        self.accept[list(accept)] = list(accept.values())
        #: Symbol of a character, and token of a symbol inside a word and at its end.
        self.code_of = np.zeros(max(map(ord, codes)) + 1, np.int64)
        self.code_of[[ord(c) for c in codes]] = list(codes.values())
        self.inner = np.array([self.tokens[self.symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([self.tokens[self.symbols[b] + "\0"] for b in range(256)], np.int64)

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words, one row each, and the words' sizes; rows end with their word's end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.code_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        out = np.full((len(words), int(sizes.max(initial=0)) + 1), 256, np.int64)
        row, k = expand(sizes)
        out[row, k] = flat
        return out, sizes

    def greedy(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from left to right, all words in step: tokens (-1 after the last) and their numbers."""
        n = len(sizes)
        out, count = np.full(symbols.shape, -1, np.int64), np.zeros(n, np.int64)
        row = np.arange(n)
        node, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        token, end = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        while len(row):
            key = node * 257 + symbols[row, at]
            edge = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            on = (self.edge_keys[edge] == key) & (at < sizes[row])
            node = np.where(on, self.edge_to[edge], 0)
            at = np.where(on, at + 1, at)
            # A token may not end between a word's last symbol and its end.
            took = on & (self.accept[node] >= 0) & (at != sizes[row] - 1)
            token, end = np.where(took, self.accept[node], token), np.where(took, at, end)
            off = np.flatnonzero(~on)
            if len(off):
                r = row[off]
                out[r, count[r]] = token[off]
                count[r] += 1
                at[off], token[off] = end[off], -1
                keep = np.ones(len(row), bool)
                keep[off[end[off] >= sizes[r]]] = False
                if not keep.all():
                    row, node, at, token, end = row[keep], node[keep], at[keep], token[keep], end[keep]
        return out, count

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words in step: the pair of the lowest rank, the leftmost of equals."""
        n, width = symbols.shape
        tokens = self.inner[np.minimum(symbols, 255)]
        last = sizes - 2
        tokens[np.arange(n), last] = self.final[symbols[np.arange(n), last]]
        count = sizes - 1
        tokens[np.arange(width) >= count[:, None]] = -1
        never = len(self.rank)
        ranks = np.full((n, width), never, np.int64)
        pair = (tokens[:, :-1] >= 0) & (tokens[:, 1:] >= 0)
        ranks[:, :-1][pair] = self.pair_rank(tokens[:, :-1][pair], tokens[:, 1:][pair])
        out, out_count = np.full((n, width), -1, np.int64), count.copy()
        row = np.arange(n)
        columns = np.arange(width)
        while len(row):
            at = np.argmin(ranks, axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best >= never
            if done.any():
                out[row[done]], out_count[row[done]] = tokens[done], count[done]
                keep = ~done
                row, tokens, ranks, count, at, best = row[keep], tokens[keep], ranks[keep], count[keep], at[keep], best[keep]
                if not len(row):
                    break
            me = np.arange(len(row))
            move = columns[None, :] > at[:, None]
            source = np.minimum(columns[None, :] + move, width - 1)
            tokens, ranks = np.take_along_axis(tokens, source, 1), np.take_along_axis(ranks, source, 1)
            tokens[:, -1], ranks[:, -1] = -1, never
            tokens[me, at] = self.merge_to[best]
            count -= 1
            for k in (at - 1, at):
                live = (k >= 0) & (k + 1 < count)
                rank = np.full(len(row), never, np.int64)
                rank[live] = self.pair_rank(tokens[me[live], k[live]], tokens[me[live], k[live] + 1])
                ranks[me[k >= 0], k[k >= 0]] = rank[k >= 0]
        return out, out_count

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a merge of neighbouring tokens, or the number of merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.rank))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens: would BPE leave the border between them alone?

        Walks the two tokens' merges back from the last; at each step the two pieces at the border
        must not have a merge of their own that comes before the merges already undone."""
        good = np.ones(len(a), bool)
        alive = np.arange(len(a))
        a, b = a.copy(), b.copy()
        never = np.int64(1) << 40
        #: Of the merges undone on each side, the latest undone: a border merge must come before it to win.
        limit_a, limit_b = np.full(len(a), never), np.full(len(a), never)
        while len(alive):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
            # At an equal rank the leftmost place wins: the border merge lies right of a's own merges and left of b's.
            bad = (rank < never) & (rank < limit_a) & (rank <= limit_b)
            good[alive[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            keep = ~bad & ((made_a >= 0) | (made_b >= 0))
            undo_a = made_a > made_b
            new_a = np.where(undo_a, self.right[a], a)
            new_b = np.where(undo_a, b, self.left[b])
            limit_a = np.where(undo_a, made_a, limit_a)[keep]
            limit_b = np.where(undo_a, limit_b, made_b)[keep]
            alive, a, b = alive[keep], new_a[keep], new_b[keep]
        return good

    def exact(self, word: str) -> list[int]:
        """Merges by rank, leftmost first, over a linked list with a heap."""
        tokens = [self.tokens[c] for c in word[:-2]] + [self.tokens[word[-2:]]]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(self.rank[p][0], k, *p) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if tokens[k] != a or n >= len(tokens) or tokens[n] != b:
                continue
            tokens[k], tokens[n] = self.rank[a, b][1], -1
            after[k] = after[n]
            if after[k] < len(tokens):
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < len(tokens) and (tokens[i], tokens[j]) in self.rank:
                    heapq.heappush(heap, (self.rank[tokens[i], tokens[j]][0], i, tokens[i], tokens[j]))
        return [t for t in tokens if t >= 0]

    def words(self, words: list[str]) -> list[list[int]]:
        """The tokens of distinct words, given in byte symbols with \\0 at the end."""
        tokens, begin, count = self._encoded(words)
        return [tokens[a : a + n].tolist() for a, n in zip(begin.tolist(), count.tolist(), strict=True)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words, all words' tokens in one array; where each word's begin, and their number."""
        begin, count, found, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 0
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        at = 0
        while at < len(order):
            # Words of like length go together, as many as fit a matrix of fixed size.
            near = sizes[at : min(at + 20_000, np.searchsorted(sizes, sizes[at] + 2, "right"))]
            full = np.flatnonzero(np.arange(len(near)) * near >= 2_000_000)
            to = at + int(full[0] if len(full) else len(near))
            which = order[at:to]
            tokens, count[which] = self._some([words[k] for k in which.tolist()])
            begin[which] = total + np.cumsum(count[which]) - count[which]
            found.append(tokens)
            total += len(tokens)
            at = to
        return np.concatenate(found), begin, count

    def _some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, sizes = self.matrix(words)
        cuts, count = self.greedy(symbols, sizes)
        pair = np.arange(cuts.shape[1] - 1) < count[:, None] - 1
        owner = np.nonzero(pair)[0]
        keys, back = np.unique(cuts[:, :-1][pair] * self.size + cuts[:, 1:][pair], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)
        failing = np.unique(owner[~good[back.ravel()]])
        if len(failing) and symbols.shape[1] <= LONG_WORD:
            cuts[failing], count[failing] = self.merged(symbols[failing], sizes[failing])
        elif len(failing):
            for k in failing.tolist():
                exact = self.exact(words[k])
                cuts[k, : len(exact)], count[k] = exact, len(exact)
        return cuts[np.arange(cuts.shape[1]) < count[:, None]], count

    def split(self, piece: str) -> list[str | int]:
        """The words of a piece without white space, in byte symbols; special tokens as their ids."""
        out: list[str | int] = []
        at = 0
        for m in self.special_re.finditer(piece) if self.special_re and "<" in piece else ():
            out += self._plain(piece[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(piece[at:]) if at else self._plain(piece)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable():
            text = text.lower()
            return [text + "\0"] if text.isalpha() else [w + "\0" for w in self.pattern.findall(text)]
        # Letters are lowered one by one: no final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return ["".join(map(self.symbols.__getitem__, w.encode())) + "\0" for w in ([text] if text.isalpha() else self.pattern.findall(text))]

    def learn(self, pieces) -> None:
        """Puts the pieces into the dictionary."""
        if not pieces:
            return
        words, sizes, plain = [], [], self._plain
        for p in pieces:
            cut = self.split(p) if "<" in p else plain(p)
            words += cut
            sizes.append(len(cut))
        # Of distinct words and special tokens: where their tokens begin, and how many they have.
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        some = [w for w in number if isinstance(w, str)]
        whole = [k for k, w in enumerate(number) if isinstance(w, str)]
        tokens, at, n = self._encoded(some)
        begin, count = np.zeros(len(number), np.int64), np.ones(len(number), np.int64)
        begin[whole], count[whole] = at, n
        special = [(k, w) for k, w in enumerate(number) if not isinstance(w, str)]
        for j, (k, _) in enumerate(special):
            begin[k] = len(tokens) + j
        tokens = np.append(tokens, [w for _, w in special]).astype(np.int64)
        which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        unit, k = expand(count[which])
        tokens = tokens[begin[which][unit] + k]
        ends = np.append(0, np.cumsum(count[which]))[np.append(0, np.cumsum(sizes))]
        first = len(self.count_of)
        self.ids_of = pa.concat_arrays([self.ids_of, _joined(self.digits, tokens, ends)])
        self.tokens_of = pa.concat_arrays([self.tokens_of, _joined(self.shown, tokens, ends)])
        self.count_of = np.append(self.count_of, np.diff(ends))
        self.pieces.update(zip(pieces, range(first, first + len(sizes)), strict=True))

    def rendered(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Per text: ids joined by a space, their number, and the decoded text."""
        ids, count, tokens = self.rendered_arrays(pa.array(texts, pa.large_string()))
        return list(zip(ids.to_pylist(), count.tolist(), tokens.to_pylist(), strict=True))

    def rendered_arrays(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """As rendered, by columns."""
        # Many small objects without cycles are made here: the collector would only walk them.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._rendered(texts)
        finally:
            if collecting:
                gc.enable()

    def _rendered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        cut = pc.ascii_split_whitespace(texts)
        ends = np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))).astype(np.int64)
        cut = cut.flatten().dictionary_encode()
        which, used = cut.indices.to_numpy(), cut.dictionary.to_pylist()
        del cut
        new = {p for p in used if p not in self.pieces}
        known = [p for p in used if p not in new]
        self.again.update(known)
        if len(self.pieces) + len(new) > CACHE_PIECES:
            kept = list(self.again) if len(self.again) + len(new) <= CACHE_PIECES else known
            at = np.fromiter(map(self.pieces.__getitem__, kept), np.int64, len(kept))
            self.ids_of, self.tokens_of, self.count_of = self.ids_of.take(pa.array(at)), self.tokens_of.take(pa.array(at)), self.count_of[at]
            self.pieces = dict(zip(kept, range(len(kept)), strict=True))
            self.again = set()
        self.learn(new)
        which = np.fromiter(map(self.pieces.__getitem__, used), np.int64, len(used))[which]
        count = self.count_of[which]
        if not count.all():
            # Pieces without tokens, and the empty ones before and after white space, leave no space.
            ends = np.append(0, np.cumsum(count > 0))[ends]
            which, count = which[count > 0], count[count > 0]
        total = np.append(0, np.cumsum(count))[ends]
        del count
        return _joined(self.ids_of, which, ends), np.diff(total), _joined(self.tokens_of, which, ends)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.rendered([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As a vocabulary without a decoder does: the tokens' strings joined by one space; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def _joined(strings: pa.Array, which: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each run of which (they begin and end at ends) its strings joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings.take(pa.array(which))), pa.scalar(" ", pa.large_string()))


def _digests(texts: pa.Array) -> pa.Array:
    """sha256 of every text, in lowercase hex."""
    ends, data = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8).tolist(), memoryview(texts.buffers()[2] or b"")
    return pa.array([sha256_hex(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _model(vocabulary: bytes) -> Bpe:
    """One model per Python worker and vocabulary; workers outlive tasks."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in HELD:
        HELD.clear()
        HELD[key] = Bpe(vocabulary)
    return HELD[key]


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        bpe = _model(shared.value)
        for batch in chunked(batches, limit=CHUNK_TEXT, keep=True):
            shown, _, decoded = bpe.rendered_arrays(text_column(batch, "text"))
            ids = pa.array([np.array(i.split(), np.int32) for i in shown.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), ids, decoded.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return _ready(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        bpe = _model(shared.value)
        for batch in chunked(batches, limit=CHUNK_TEXT, keep=True):
            ids, count, decoded = bpe.rendered_arrays(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(count, pa.int64()), _digests(ids), _digests(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _ready(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
