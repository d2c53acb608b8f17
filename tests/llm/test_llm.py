"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quern.llm import bpe, common, decontam, html, language, media, neardup, pii, quality, queries, recurrent, substrings

NAMES = list(queries.QUERIES)
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (None, "word " * 40), (7, "word " * 40), (7, "other"), (8, "x" * 50_000), (9, "w1 w2 w3 " * 3000), (10, "\x00é😀￾ 日本")]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "extra", "clash") for i, t in EDGES], "doc_id long, text string, words string, _row string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té,.X", max_size=60), max_size=6))
def test_word_spans_and_hashes(texts):
    data, offsets = common.text_buffer(pa.array(texts, pa.large_string()))
    starts, stops, doc = common.word_spans(data, offsets)
    got = [(int(d), data[a:b].tobytes().decode()) for a, b, d in zip(starts, stops, doc, strict=True)]
    assert got == [(d, w) for d, t in enumerate(texts) for w in words(t)]
    hashes = common.hash_spans(data, starts, stops)
    assert len({w for _, w in got}) == len(set(hashes.tolist()))


def test_run_hash_depends_on_content_only():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 5, 200).astype(np.uint64)
    for size in (1, 2, 5, 10, 15, 35):
        h = common.run_hash(w, size)
        assert len(h) == 200 - size + 1
        by = collections.defaultdict(set)
        for k in range(len(h)):
            by[tuple(w[k : k + size])].add(int(h[k]))
        assert all(len(v) == 1 for v in by.values()) and len({v for s in by.values() for v in s}) == len(by)


# 1: media
@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=5))
def test_jpeg_round_trip(raw):
    payloads = [r + b" " * ((-len(r)) % 192 if r else 192) for r in raw]
    files = media.write_jpegs(payloads)
    reader = media.Reader(files)
    assert media.read_payloads(files, reader) == payloads
    assert files == [media.write_jpegs([p])[0] for p in payloads]
    sums = media.colour_sums(reader)
    for k in range(len(files)):
        t = reader.tensor(k)
        assert t.shape == (reader.images[k].height, reader.images[k].width, 3) and (t.reshape(-1, 3).sum(axis=0) == sums[k]).all()


def test_jpeg_inverse_transform_is_a_cosine_transform():
    coefs = np.zeros((1, 64), np.int32)
    coefs[0, 0] = 80
    assert (media._samples(coefs) == 138).all()


def test_media_edges(edges):
    rows = media.media_digest(edges).collect()
    assert len(rows) == len(EDGES)
    by = {(r.doc_id, r.payload_sha256): r for r in rows}
    for i, t in EDGES:
        raw = (t or "").encode()
        pad = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = by[i, hashlib.sha256(pad).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(pad), zlib.crc32(pad[-16:]))
    r = next(r for r in media.media_columns(edges).collect() if r.doc_id == 10)
    assert r.payload.decode() == EDGES[-1][1] and len(r.rgb) == r.height * r.width * 3


# 2: substrings
def brute_substrings(rows):
    found = collections.Counter()
    for _, t in rows:
        w = words(t)
        found.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if found[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_substrings_against_brute_force(spark, edges):
    random.seed(5)
    base = [random.choice("abcdefgh") + str(random.randrange(40)) for _ in range(120)]
    rows = list(EDGES)
    for k in range(12):
        a, n = random.randrange(60), random.choice([20, 34, 35, 36, 60])
        rows.append((100 + k, " ".join([f"u{k}{j}" for j in range(random.randrange(50))] + base[a : a + n] + [f"v{k}{j}" for j in range(random.randrange(9))])))
    got = substrings.removed_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows)


# 3: BPE
def test_bpe_equals_the_library(docs, edges):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = [t or "" for _, t in EDGES] + [r.text or "" for r in docs.select("text").collect()] + ["a<|endoftext|>b", "ΑΣ Σς İ", "don't THE'RE 12½", "\x1ca b\x85c"]
    mine = bpe.Bpe(bpe.vocabulary_bytes())
    for t, (ids, n, text) in zip(texts, mine.rendered(texts), strict=True):
        e = lib.encode(t, add_special_tokens=False)
        assert (ids, n, text) == (" ".join(map(str, e.ids)), len(e.ids), lib.decode(e.ids, skip_special_tokens=False))
    rows = bpe.encode(edges).collect()
    assert len(rows) == len(EDGES) and all(mine.decode(r.ids) == r.decoded for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinorstlhd'1é!", min_size=1, max_size=40))
def test_bpe_on_any_word(text):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    if not hasattr(test_bpe_on_any_word, "pair"):
        test_bpe_on_any_word.pair = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")), bpe.Bpe(bpe.vocabulary_bytes())
    lib, mine = test_bpe_on_any_word.pair
    assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids
    for w in mine.split("".join(text.split())):
        assert mine.exact(w) == mine.words([w])[0]


def test_bpe_dictionary_is_bounded_and_goes_with_its_stage(monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    vocabulary, learnt = bpe.vocabulary_bytes(), []
    texts = ["a b c", "c d", "c e f g", "c f", "h i j k l m n", "a"]
    alone = [bpe.Bpe(vocabulary).rendered([t])[0] for t in texts]
    mine = bpe._model(vocabulary)
    monkeypatch.setattr(bpe.Bpe, "learn", lambda self, pieces, real=bpe.Bpe.learn: (learnt.append(set(pieces)), real(self, learnt[-1])))
    assert [mine.rendered([t])[0] for t in texts] == alone
    # At the bound (third text) the piece that came again stays; a text of more pieces than the bound is encoded whole.
    assert learnt == [set("abc"), set("d"), set("efg"), set(), set("hijklmn"), set("a")]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert list(common.chunked(iter([batch]), keep=True)) and bpe._model(vocabulary) is mine
    # Another stage in the same worker drops vocabulary and dictionary.
    assert list(common.chunked(iter([batch]))) and not common.HELD


def test_bpe_columns_equal_the_library(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    blanks = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF)]
    texts = [f"{b}the{b}{b}\u0301Cat's{b} é{b}" for b in blanks] + ["", " ", "\u3000", " \xa0 a\xa0 ", "a<|endoftext|> <|startoftext|>b", "<|endoftext|>\u2003<|endoftext|>", "İ ǅungla ªº 中文 e\u0301e", "Zz" * 90 + " x", "<|x"]
    want = [(" ".join(map(str, e.ids)), len(e.ids), lib.decode(e.ids, skip_special_tokens=False)) for e in (lib.encode(t, add_special_tokens=False) for t in texts)]
    for bound in (300_000, 3):
        monkeypatch.setattr(bpe, "CACHE_PIECES", bound)
        mine = bpe.Bpe(bpe.vocabulary_bytes())
        for a, b in ((0, 7), (7, len(texts)), (0, len(texts))):
            ids, count, shown = mine.rendered_arrays(pa.array(texts, pa.large_string()).slice(a, b - a))
            assert list(zip(ids.to_pylist(), count.tolist(), shown.to_pylist(), strict=True)) == want[a:b]
            assert bpe._digests(ids.slice(1)).to_pylist() == [common.sha256_hex(w[0].encode()) for w in want[a + 1 : b]]
            assert len(mine.pieces) == len(mine.count_of) == len(mine.ids_of) == len(mine.tokens_of)


# 4: quality
def test_quality_held_out(docs, labels, edges):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.8 * len(held)
    assert quality.classify(edges, labels).count() == len(EDGES)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


# 5: language model
def test_recurrent_counts_and_gain(docs, edges):
    rows = recurrent.score(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    low = {c: c + 32 for c in range(65, 91)}
    tok = {i: [*words((t or "").translate(low)), None] for i, t in text.items()}
    c = collections.Counter(w for i, x in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    for r in rows:
        x = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert recurrent.score(edges).count() == len(EDGES)


def test_recurrent_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    assert abs(recurrent.vocabulary(16 * 10**6) - 2 * recurrent.vocabulary(10**6)) <= 1
    sizes, real, begin = [], recurrent.Network, recurrent.Network.__init__
    monkeypatch.setattr(real, "__init__", lambda self, hashes, *more: sizes.append(hashes) or begin(self, hashes, *more))
    for n in (300, 4800):
        # Word k occurs more often than word k + 1, and texts end: the vocabulary is the end and the first words.
        rows = [(i, " ".join(f"w{k}" for k in range(i + 1))) for i in range(n) if zlib.crc32(str(i).encode()) % 5 != 1][: n // 10]
        recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        total = sum(len(t.split()) + 1 for _, t in rows)
        distinct = max(len(t.split()) for _, t in rows) + 1
        assert len(sizes[-1]) == min(recurrent.vocabulary(total), distinct) and sizes[-1][0] == recurrent.END
    monkeypatch.undo()
    big = real(np.arange(1, 40_000, dtype=np.uint64))
    assert big.kind is np.int32 and real(np.arange(1, 100, dtype=np.uint64)).kind is np.int16 and big.groups * big.width >= big.size


def test_recurrent_gradient():
    rng = np.random.default_rng(1)
    net = recurrent.Network(np.arange(1, 101, dtype=np.uint64))
    for k in net.w:
        net.w[k] = rng.normal(size=net.w[k].shape).astype(np.float64) * 0.3
    states, ids = rng.normal(size=(6, recurrent.HIDDEN)), np.array([0, 5, 50, 99, 101, 110])
    grad = {k: np.zeros_like(x) for k, x in net.w.items()}
    _, back = net.output(states, ids, grad)
    for k, at in (("c", (3, 1)), ("v", (50, 2)), ("vb", (5,))):
        old, eps = net.w[k][at], 1e-5
        net.w[k][at] = old + eps
        up = net.output(states, ids)[0].sum()
        net.w[k][at] = old - eps
        assert abs((up - net.output(states, ids)[0].sum()) / (2 * eps) - grad[k][at]) < 1e-5
        net.w[k][at] = old
    moved = states.copy()
    moved[2, 4] += 1e-5
    assert abs((net.output(moved, ids)[0].sum() - net.output(states, ids)[0].sum()) / 1e-5 - back[2, 4]) < 1e-3


@pytest.mark.parametrize("kind, words", [(np.int16, 2000), (np.int32, 90_000)])
def test_recurrent_windows_hold_all_tokens(kind, words):
    counts = np.array([1, 64, 65, 20_000, 300])
    ids = np.concatenate([np.append(np.random.default_rng(3).integers(1, words, n - 1), 0) for n in counts])
    windows = recurrent.windows_of(ids, counts, kind)
    assert (windows[:, 1:][windows[:, 1:] >= 0] == ids).all()
    ends = np.cumsum(-(-counts // recurrent.WINDOW))
    again, fresh = recurrent._read([windows[a:b].tobytes() for a, b in zip([0, *ends], ends)], kind)
    assert (again == windows).all()
    starts = ends - -(-counts // recurrent.WINDOW)
    carried = recurrent.CARRIED
    assert set(np.flatnonzero(fresh)) == {int(s) + k for s, e in zip(starts, ends) for k in range(0, int(e - s), carried)}
    rest = np.setdiff1d(np.arange(len(windows)), starts)
    assert (windows[rest, 0] == windows[rest - 1, -1]).all() and not windows[starts, 0].any()


def test_recurrent_segment_gradient():
    rng = np.random.default_rng(5)
    net = recurrent.Network(np.arange(1, 60, dtype=np.uint64))
    for k in net.w:
        net.w[k] = rng.normal(size=net.w[k].shape) * 0.2
    part = rng.integers(0, 75, (3, 9))
    part[1, 5:] = -1
    h = rng.normal(size=(3, recurrent.HIDDEN)) * 0.1

    def mean():
        total, count = 0.0, 0
        for row, state in zip(part, h):
            state = state[None]
            for now, after in zip(row, row[1:]):
                if after >= 0:
                    state = net.step(state.copy(), np.array([now]))
                    total, count = total + net.output(state, np.array([after]))[0][0], count + 1
        return total / count

    grad, _ = net._segment(part, h)
    norm = None
    for k, at in (("u", (2, 3)), ("u", (1, recurrent.HIDDEN + 2)), ("u", (0, 2 * recurrent.HIDDEN + 1)), ("x", (int(part[0, 2]), 5)), ("c", (3, 1))):
        old, eps = net.w[k][at], 1e-5
        net.w[k][at] = old + eps
        up = mean()
        net.w[k][at] = old - eps
        slope = (up - mean()) / (2 * eps)
        net.w[k][at] = old
        # Gradients may be scaled down together to norm 1.
        norm = norm or slope / grad[k][at]
        assert math.isclose(slope, grad[k][at] * norm, rel_tol=1e-3, abs_tol=1e-7)
    assert norm >= 1 - 1e-6


def test_recurrent_score_against_word_by_word():
    rng = np.random.default_rng(9)
    net = recurrent.Network(np.arange(1, 120, dtype=np.uint64))
    for k in net.w:
        net.w[k] = (rng.normal(size=net.w[k].shape) * 0.3).astype(np.float32)
    counts = np.array([1, 40, 7, 200])
    ids = rng.integers(0, 119 + recurrent.FORMS, counts.sum())
    got, at = net.score(ids, counts), 0
    sig = lambda x: 1 / (1 + np.exp(-x))
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    H, C = recurrent.HIDDEN, net.width
    for d, n in enumerate(counts):
        h, last, total = np.zeros(H), 0, 0.0
        for i in ids[at : at + n]:
            x, u = w["x"][last], h @ w["u"]
            z, r = sig(x[:H] + u[:H]), sig(x[H : 2 * H] + u[H : 2 * H])
            m = np.tanh(x[2 * H :] + r * u[2 * H :])
            h = (1 - z) * m + z * h
            c = i // C if i < net.size else net.groups + i - net.size
            p = np.exp(h @ w["c"] + w["cb"])
            total += math.log10(p[c] / p.sum())
            if i < net.size:
                q = np.exp(w["v"][c * C : (c + 1) * C] @ h + w["vb"][c * C : (c + 1) * C])
                total += math.log10(q[i - c * C] / q.sum())
            last = i
        at += n
        assert math.isclose(got[d], total, rel_tol=1e-4, abs_tol=1e-4)


def test_recurrent_score_steps_are_bounded(monkeypatch):
    net, rng = recurrent.Network(np.arange(1, 120, dtype=np.uint64)), np.random.default_rng(5)
    net.w = {k: (rng.normal(size=v.shape) * 0.3).astype(np.float32) for k, v in net.w.items()}
    counts = rng.integers(1, 9, recurrent.IN_STEP * 2 + 3)
    ids, rows = rng.integers(0, 119 + recurrent.FORMS, counts.sum()), []
    monkeypatch.setattr(recurrent.Network, "step", lambda self, h, *a, real=recurrent.Network.step: (rows.append(len(h)), real(self, h, *a))[1])
    whole = net.score(ids, counts)
    assert max(rows) == recurrent.IN_STEP and sum(rows) == len(ids)
    monkeypatch.setattr(recurrent, "IN_STEP", 7)
    assert np.allclose(net.score(ids, counts), whole, rtol=1e-5)


def test_recurrent_blocks_change_nothing(monkeypatch):
    texts = pa.array([t or "" for _, t in EDGES] + ["Été a b", "", "x" * 90], pa.large_string())
    net, rng = recurrent.Network(np.arange(1, 120, dtype=np.uint64)), np.random.default_rng(3)
    for k in net.w:
        net.w[k] = rng.normal(size=net.w[k].shape) * 0.3
    states, ids = rng.normal(size=(300, recurrent.HIDDEN)), rng.integers(0, 119 + recurrent.FORMS, 300)
    order = np.argsort(ids, kind="stable")
    found, edges = np.unique(ids[order], return_index=True)

    def results():
        grad = {k: np.zeros_like(v) for k, v in net.w.items()}
        return [*recurrent.tokens(texts), net.ids(ids.astype(np.uint64), ids % recurrent.FORMS), *net.output(states, ids, grad), *grad.values(), recurrent._run_sums(states, order, edges)]

    whole = results()
    assert len(whole[0]) == whole[2].sum() and len(whole[2]) == len(texts)
    assert np.allclose(whole[-1], [states[ids == i].sum(axis=0) for i in found])
    # Logits too large to be exponentiated as they are go the other way.
    for name, value in (("TEXT_BLOCK", 1), ("ID_BLOCK", 7), ("ROW_BLOCK", 7), ("LONG_RUN", 2), ("SMALL", 0)):
        monkeypatch.setattr(recurrent, name, value)
        assert all(np.allclose(a, b, rtol=1e-9, atol=1e-9) for a, b in zip(results(), whole, strict=True))
    net.w["cb"][3] = 1e4
    assert np.isfinite(net.output(states, ids)[0]).all()


def test_recurrent_scores_do_not_follow_settings(spark, docs):
    scores = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        scores.append({r.doc_id: r.score for r in recurrent.score(docs).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(x, scores[1][i], rel_tol=1e-5) for i, x in scores[0].items())


# 6: decontamination
def test_decontamination(spark, docs, data, monkeypatch):
    items = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "short item"), ("c", None), (None, "null named words"), ("a", "again here")]
    texts = [(1, "x ONE two-three four five six seven eight nine ten eleven y"), (2, "a short item"), (3, None), (4, "null named words"), (5, "one two three"), (6, "again here and short item"), (7, "")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = {1: (13, 11, "a"), 2: (3, 2, "b"), 3: (0, 0, ""), 4: (3, 3, ""), 5: (3, 0, ""), 6: (5, 4, "a,b"), 7: (0, 0, "")}
    for size in (1 << 20, 20):  # one block of the benchmark, and many
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        rows = decontam.find_contamination(d, b).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in rows} == {i: (n, h, sha(s)) for i, (n, h, s) in want.items()}
        assert {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in rows}[1] == (11, 1, "a")
    assert sorted(r.doc_id for r in decontam.remove_contaminated(d, b).collect()) == [3, 5, 7]
    assert decontam.find_contamination(d, b.limit(0)).where("contaminated").count() == 0 and decontam.find_contamination(d.limit(0), b).count() == 0


# 7: near duplicates
def profile(text):
    """Shingles of five words and their weights."""
    w = words(text)
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return {g: 1 + math.log(n) for g, n in grams.items()}


def probability_jaccard(a, b):
    both = a.keys() | b.keys()
    if all(v == 1 for v in (*a.values(), *b.values())):
        return len(a.keys() & b.keys()) / len(both)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both) for d in a.keys() & b.keys())


def test_probability_jaccard():
    random.seed(1)
    a = {k: random.random() + 0.1 for k in range(40)}
    b = {k: random.random() + 0.1 for k in range(20, 60)}
    both = a.keys() | b.keys()
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both) for d in a.keys() & b.keys())
    pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
    assert math.isclose(neardup.similarity(pack(a), pack(b)), want)
    keys = common.mix(np.arange(60, dtype=np.uint64))
    owner = np.array([0] * 40 + [1] * 40)
    hashed = np.concatenate([keys[:40], keys[20:]])
    weight = np.array([a[k] for k in range(40)] + [b[k] for k in range(20, 60)])
    r = neardup.registers(owner, hashed, weight, 2, 4000)
    assert abs((r[0] == r[1]).mean() - want) < 0.03


def test_near_duplicates(spark):
    random.seed(2)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "  ".join(base)), (4, None), (5, ""), (6, None), (7, "a b"), (8, "a b"), (None, "a b"), (20, "c d e f g h")]
    for k in range(30):
        w = list(base)
        w[random.randrange(120)] = f"z{k}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect() if r.doc_id}
    assert all(got[i] == 1 for i in [1, 2, 3, *range(100, 130)]) and [got[i] for i in (4, 5, 6, 7, 8, 20)] == [4, 5, 6, 7, 7, 20]
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect() if r.doc_id) == [1, 4, 5, 6, 7, 20]


def test_near_duplicates_against_brute_force(spark):
    """Every pair of the table that is so similar lies in one class, and every class hangs together by such pairs."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    text = {r.doc_id: profile(r.text) for r in rows}
    text = {i: p for i, p in text.items() if p}
    holders = collections.defaultdict(list)
    for i, p in text.items():
        for g in p:
            holders[g].append(i)
    mass, parent, links = {i: sum(p.values()) for i, p in text.items()}, {i: i for i in text}, []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in text.items():
        shared = collections.Counter()
        for g, w in p.items():
            for j in holders[g]:
                if j < i:
                    shared[j] += w
        # The similarity is at most the share of a text's weight that the other has as well.
        for j, w in shared.items():
            if w >= 0.8 * mass[i] - 1e-9 and min(len(text[i]), len(text[j])) >= 0.4 * max(len(text[i]), len(text[j])) and probability_jaccard(p, text[j]) >= 0.8 - 1e-9:
                links.append((i, j))
                parent[root(i)] = root(j)
    assert len(links) > 50 and sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)
    assert all(root(i) == root(got[i]) for i in text if got[i] in text)


def test_forest_against_brute_force():
    random.seed(6)
    for _ in range(8):
        base = [random.choice("abcdefgh") + str(random.randrange(30)) for _ in range(40)]
        texts = []
        for _ in range(24):
            w = list(base) + base[: random.randrange(12)] * random.randrange(3)
            for _ in range(random.randrange(3)):
                w[random.randrange(len(w))] = f"z{random.randrange(9)}"
            texts.append(" ".join(w))
        labels, side = np.array([random.randrange(12) for _ in texts]), np.array([random.choice([0, 1]) for _ in texts])
        found = neardup.forest(labels, side, pa.array(texts, pa.large_string()), 0.8)
        p = [profile(t) for t in texts]
        want = {(a, b) for a in np.flatnonzero(side == 0) for b in np.flatnonzero(side == 1) if labels[a] != labels[b] and probability_jaccard(p[a], p[b]) >= 0.8 - 1e-9}
        assert set(found) <= want

        def groups(pairs):
            of = {int(x): int(x) for x in labels}
            for a, b in pairs:
                x, y = of[int(labels[a])], of[int(labels[b])]
                of = {k: x if v == y else v for k, v in of.items()}
            return {frozenset(k for k in of if of[k] == v) for v in of.values()}

        assert groups(found) == groups(want)


def test_near_duplicates_of_odd_rows(spark, edges):
    long = " ".join(f"u{k}" for k in range(50))
    rows = [(1, long, "a", 1), (1, "wholly different words that nobody else has", "b", 2), (2, long, "c", 3), (3, "wholly different words that nobody else has", "d", 4), (5, "own text of five words or more", "e", 5), (5, "own text of five words or more", "e", 5), (None, long, "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, node long")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r._gone for r in kept.collect()) == ["a", "b", "e", "e", "f"]
    assert sorted(r.class_id for r in neardup.near_duplicates(df).where("doc_id IS NOT NULL").collect()) == [1, 1, 1, 1, 5, 5]
    got = neardup.near_duplicates(edges)
    assert got.count() == len(EDGES) and neardup.keep_one(edges).columns == edges.columns
    assert {(r.doc_id, r.class_id) for r in got.collect()} >= {(4, 4), (5, 4), (7, 7), (1, 1), (2, 2), (None, None)}


def test_hot_keys_are_dealt(spark):
    from quern.llm import tables

    many = spark.range(2000).selectExpr("if(id < 1500, 0, id) AS k", "id AS v")
    one = spark.range(1400, 2100).selectExpr("id AS k", "id * 2 AS w").unionByName(spark.sql("SELECT 0L AS k, 7L AS w"))
    sizes = many.groupBy("k").count().withColumnRenamed("count", "n")
    got = sorted(map(tuple, tables.dealt_join(many, one, ["k"], sizes, "v").select("k", "v", "w").collect()))
    assert got == sorted([(0, v, 7) for v in range(1500)] + [(v, v, 2 * v) for v in range(1500, 2000)])


# 8: personal data
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum((int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4)) for i, c in enumerate(reversed(digits)))
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and double % 10 == 0, 10 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, edges):
    random.seed(3)
    bits = ["1", "255", "256", "@", "a.b", ".", "+", " ", "-", "(", ")", "4539 1488 0343 6467", "4539148803436467", "é😀", "￾", "\n", "a@b.co", "192.168.0.1", "+1 (243) 555-5526"]
    rows = EDGES + [(1000 + i, "".join(random.choices(bits, k=random.randint(0, 30)))) for i in range(400)] + [(5000, "a.b@" * 500), (5001, "1.2.3.4." * 100), (5002, "1" * 3000)]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = collections.defaultdict(set)
    for i, t in rows:
        text[i].add(base_spans(t))
    for r in got:
        match = [b for b in text[r.doc_id] if sha(b) == r.base_sha256]
        assert match and (set(match[0].split(",")) <= set(r.spans.split(",")) or not match[0])
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame([(1, "mail a@b.co now"), (2, None), (3, "none")], "doc_id long, text string")).collect()}
    assert clean == {1: "mail [EMAIL] now", 2: None, 3: "none"}
    assert pii.redacted(edges).columns == edges.columns


def test_personal_data_extra_spans(spark):
    """Confirmed formats add spans, refuted ones don't; extra spans overlap neither base spans nor each other."""
    random.seed(11)
    rows, number = [], lambda: f"({random.randrange(100, 1000)}) 555-{random.randrange(1000, 10000)}"
    for k in range(300):
        rows.append((k, f"some text {random.choice(['', 'phone '])}+1 {number()} and a host {random.randrange(256)}.1.2.3 there"))
    extra = number()
    rows += [(1000, f"reach us {extra} today"), (1001, f"code 12-{extra[1:4]}-99"), (1002, "write to jane [at] example [dot] com or call"), (1003, "1.2.3.4 " * 3000)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].spans == f"phone:9:{9 + len(extra)}" and got[1000].n_phone == 0 and got[1001].spans == ""
    assert got[1003].n_ip == 3000 and got[1003].spans.endswith(f"ip:{8 * 2999}:{8 * 2999 + 7}")
    for i, t in rows:
        spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x))
        base = base_spans(t)
        added = [x for x in got[i].spans.split(",") if x and x not in base.split(",")]
        assert not added or all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_boosted_trees_calibrate():
    rng = random.Random(4)
    rows = [((3, 1, d, m, 2, 1, 1), 100.0, float(95 + rng.randrange(6) if d == 3 else rng.randrange(30))) for d in range(6) for m in range(7)]
    trees = pii.Trees(rows)
    low = pii.Trees.thresholds([(v[0], v[1], trees.rate(v), n, good) for v, n, good in rows])
    assert low[0] == 2.0 and all((trees.rate(v) >= low[7]) == (v[2] == 3) for v, _, _ in rows)


# 9: language
def test_language(docs, edges):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    from pyspark.sql import functions as F

    got = {r.doc_id: r.lang_pred for r in language.predict(edges, language.fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[9] != "und"
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_changes_inside_a_text(docs):
    """Texts of two languages joined: the shares follow the parts, and transitions allow for a change."""
    chain = language.fit(docs)
    by = collections.defaultdict(str)
    for r in docs.where("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").collect():
        by[r.lang] = by[r.lang] or r.text[:400]
    names = sorted(by)
    for a, b in zip(names, names[1:]):
        shares = dict(zip(chain.languages, chain.shares(pa.array([f"{by[a]} {by[b]}"], pa.large_string()))[0]))
        assert shares[a] > 0.25 and shares[b] > 0.25
    assert np.isfinite(chain.moves).all() and (np.diag(chain.moves) > (chain.moves.sum(axis=1) - np.diag(chain.moves)) / (len(names) - 1)).all()


def test_language_sequences():
    doc = np.repeat(np.arange(54), [0, 5, 60, 61, 200, 31, 400, 30, 100] * 6)
    labels = np.arange(54) % 3
    sequence, column, gold = language.sequences(doc, labels)
    assert (gold == labels[doc]).all() and len({(a, b) for a, b in zip(sequence, column)}) == len(doc)
    for s in set(sequence.tolist()):
        assert sorted(column[sequence == s]) == list(range((sequence == s).sum()))
    assert any(len(set(gold[sequence == s])) == 2 for s in set(sequence.tolist()))


def test_forward_backward_is_exact():
    chain = language.Chain(["a", "b", "c"])
    rng = np.random.default_rng(4)
    chain.table = rng.normal(size=chain.table.shape).astype(np.float32)
    chain.moves = rng.normal(size=(3, 3))
    text = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(150))
    doc, number, owner, slot, kinds = language._types(pa.array([text], pa.large_string()))
    e = chain.scores(owner, slot, kinds)[number]
    a, f, b, total = np.exp(chain.moves), [np.full(3, 1 / 3)], np.ones(3), np.zeros(3)
    for p in np.exp(e):
        x = (f[-1] @ a) * p
        f.append(x / x.sum())
    for t in range(len(e) - 1, -1, -1):
        p = f[t + 1] * b
        total += p / p.sum()
        b = a @ (np.exp(e[t]) * b)
        b /= b.sum()
    assert np.allclose(chain.shares(pa.array([text], pa.large_string()))[0], total / len(e))


# 10: HTML
def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/x'>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head</h1><p>One &amp; <b>tw</b>o<p>three<script>x</script><div class=comments>reader</div></article><footer>&copy; x</footer></body></html>"
    assert html.main_text(page, lambda n: [0] * len(n)) == "Head One & two three"
    plain = [f"<body><div><p>Same words here</p><p>On every page</p><p>of this host</p><p>{k} own text of page {k}</p></div></body>" for k in range(6)]
    rows = [(k, "http://h.example.org/a", p) for k, p in enumerate(plain)] + [(50, None, None), (51, "u", ""), (52, "http://h2.example.org", "<p>cut &am"), (None, "http://h3", "<<<>>> &lt; a"), (53, "x", "<div" * 2000)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(6)] == [f"{k} own text of page {k}" for k in range(6)]
    assert got[50].text == got[51].text == "" and got[52].text == "cut &am" and got[52].n_chars == 7 and len(got) == len(rows)


def test_html_template_decides_in_articles(spark):
    page = "<body><article><h1>Title {k}</h1><p>{k} own text of page {k}</p><div class='box'><p>Same words here</p><p>On every page</p><p>of this host</p></div></article></body>"
    rows = [(k, "http://h.example.org/a", page.format(k=k)) for k in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} {k} own text of page {k}" for k in range(6)}


def test_html_copies_and_sections(spark):
    page = "<body><nav>{0}</nav><div><p>First {1}</p><p>Second {1}</p><p>Third {1}</p></div></body>"
    rows = [(k, "http://copies.org/", page.format(k, "copied")) for k in range(2)] + [(7, "http://same.org/", page.format(k, k // 2)) for k in range(4)]
    side = "<body><div><p>{0} side</p><p>{0} more</p><p>{0} end</p><p>own {1}</p></div></body>"
    rows += [(100 + 4 * s + k, f"http://s.org/{d}/{k}", side.format(d, f"{s}-{k}")) for s, d in enumerate("abc") for k in range(4)]
    got = sorted((r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    copies = [(k, "First copied Second copied Third copied") for k in range(2)] + [(7, f"First {k} Second {k} Third {k}") for k in (0, 0, 1, 1)]
    assert got == copies + [(100 + 4 * s + k, f"own {s}-{k}") for s in range(3) for k in range(4)]


def test_html_classes_nest():
    assert html.nested([1, 2, 2, 1, 3, 0, 3]) == {1, 2, 3}
    assert html.nested([1, 2, 1, 2, 1, 0]) == {1}  # classes that cross: the larger one stays
    assert html.nested([1, 1, 2, 3, 3, 2, 1]) == {1, 2, 3} and html.nested([0, 0]) == set()


def test_html_classes_against_brute_force(spark):
    """Valid classes by whole occurrence vectors; and the joined way equals the broadcast one."""
    random.seed(8)
    rows = []
    for k in range(40):
        boxes = [f"<div class=b{b}><p>box {b}</p><p>more {b}</p><p>end {b}</p></div>" for b in range(4) if random.random() < 0.6]
        rows.append((k, f"http://h{k % 3}.org/{'ab'[k % 2]}/{k}", f"<body>{boxes[0] if boxes else ''}<div><p>own {k // 2}</p><p>text {random.randrange(30)}</p></div>{''.join(boxes[1:])}</body>"))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS template", "1 AS page")
    parsed = html._hosted(df).select("host", "section", "page", "html").mapInArrow(html._parsed, "host string, section long, page long, layout long, content long, tokens array<long>, times array<int>")
    got = {(r.host, r.token) for r in html.templates(parsed).collect()}
    by = {}
    for r in sorted(parsed.collect(), key=lambda r: -r.page):
        by[r.host, r.content] = r
    want = set()
    for host in {h for h, _ in by}:
        mine = [r for (h, _), r in by.items() if h == host]
        vectors = collections.defaultdict(dict)
        for n, r in enumerate(mine):
            for token, times in zip(r.tokens, r.times):
                vectors[token][n] = times
        classes = collections.defaultdict(list)
        for token, v in vectors.items():
            classes[tuple(sorted(v.items()))].append(token)
        for v, members in classes.items():
            like = [len(mine)]
            for kind in ("section", "layout"):
                of = {mine[n][kind] for n, _ in v}
                if len(of) == 1 and len(v) >= 3:
                    like.append(sum(r[kind] in of for r in mine))
            if len(members) >= 3 and len(v) >= 2 and len(v) >= 0.5 * min(like):
                want |= {(host, t) for t in members}
    assert got == want and want
    ways = [sorted(map(tuple, html.extract(df, n).collect())) for n in (1 << 20, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 45


def test_html_odd_pages(spark):
    long = "<article>" + "<p>" + " ".join(f"word{k}" for k in range(60_000)) + "</p>" + "<div>" * 3000 + "deep" + "</i>" * 3000
    rows = [(1, None, None), (1, "", ""), (None, "http://a.org/x", long), (2, "http://a.org/x", long), (3, "http://a.org/y", "<a href=x><b><i><u>all link text</u></i></b></a>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.Counter((r.page_id, r.text[:5], r.n_chars) for r in got)
    size = len(" ".join(f"word{k}" for k in range(60_000))) + 5
    assert texts == {(1, "", 0): 2, (None, "word0", size): 1, (2, "word0", size): 1, (3, "", 0): 1}


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    for f in (media.media_digest, substrings.removed_words, bpe.encode_digest, recurrent.score, neardup.near_duplicates, pii.digest, language.identify):
        assert f(none).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_keeps_clean_documents(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs.count()
    assert kept >= 0.5 * 200 and corpus_pipeline.run(spark, data).count() == kept


def test_components_either_way(spark, monkeypatch):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (7, 3), (8, 20), (30, 31)], "node long, pivot long")
    want = {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    assert {r.node: r.label for r in neardup.components(links).collect()} == want
    monkeypatch.setattr(neardup, "LOCAL_LINKS", 0)
    assert {r.node: r.label for r in neardup.components(links).collect()} == want
