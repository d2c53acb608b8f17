"""Personal data by high-recall generators and gradient-boosted trees, in DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks; they always count.  Further
candidates come from looser generators (mail addresses with spelt or bracketed signs, national phone
numbers, IPv6, whole or compressed) and from base matches that failed their check.  Boosted trees of depth
two learn from format and context how likely a span is personal data.  They never see what labels it: for a
base match, its check; for a looser candidate, what stands over it (a valid base span of its kind confirms it,
any other base match refutes it) or, where nothing does, a keyword of its kind before it confirms it; all
others are not learnt from.  The corpus is reduced to counts of distinct feature vectors (at most `VECTORS`, in
two halves of the documents) before anything reaches the driver.  Trees are fitted on one half; on the other,
each kind and generator gets as threshold the lowest probability at which the labelled spans reach `PRECISION`,
or none where it has no labelled span.  Candidates above it that do not overlap a base span are added, of
overlapping ones the likelier, at equal probability the first.

Spans come from regexp_replace with a separator that no text keeps, split, and sums of lengths (in blocks of
`STRIDE`): so starts and ends are code points.  Patterns use possessive repeats and lookbehind where that
changes no match, so a text costs time in proportion to its length.

Defined results: null and empty texts have no spans; very long texts are searched whole; rows keep
their doc_id, repeated or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Stands between pieces of a marked text; a text's own is replaced by U+0001, which no pattern knows.
MARK = "￾"

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of digits with single separators, of 14 to 19 digits; all others fail the check.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"

_AT, _DOT = r"(?i:@| ?[\[({] ?(?:at|@) ?[\])}] ?| at )", r"(?i:\.| ?[\[({] ?(?:dot|punkt|punto|point|\.) ?[\])}] ?| dot )"
LOOSE_EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+{_AT}[A-Za-z0-9-]{{2,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}+"
LOOSE_IP = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}(?:[ ./-][0-9]{2,4}){2,4}|0[0-9]{1,4}[ ./-][0-9]{5,8})(?![0-9A-Za-z])"
#: Words that announce a kind, at the end of what stands before a span.
KEYWORDS = ("mail|contact|write to|correo|courriel", "ip|host|server|addr|address", "card|visa|carte|karte|tarjeta|mastercard", "tel|phone|call|fax|mobile|telefon|handy|teléfono")

FEATURES = {"kind": 4, "loose": 2, "digits": 6, "marks": 7, "size": 7, "before": 4, "after": 4}
VECTORS = math.prod(FEATURES.values())
ROUNDS, RATE, RIDGE = 12, 0.5, 1.0
PRECISION = 0.95
#: Lengths whose sum is taken at once.
STRIDE = 128

_SPAN = "array<struct<start:int,kind:int,end:int,m:string,l:string,r:string,ok:boolean,loose:int>>"
_PLAIN = "array<struct<start:int,kind:int,end:int>>"


def _pieces(pattern: str, when: Column) -> Column:
    """Gap, match, gap, match ... gap; null where the text can't hold a match."""
    return F.when(when, F.split(F.regexp_replace("_t", F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1))


def _spans(name: str, kind: int, ok: str, loose: int) -> Column:
    """The matches in the pieces of column `name`, with 24 characters before and 1 after; ok: a check of x.m."""
    before = f"q.o[CAST(i / {STRIDE} AS INT)] + aggregate(slice(q.n, CAST(i / {STRIDE} AS INT) * {STRIDE} + 1, i % {STRIDE}), 0, (a, x) -> a + x)"
    # The arrays are bound to q: what a lambda names directly may be computed again for each element.
    return F.expr(f"""CASE WHEN size({name}) > 2 THEN transform(array(named_struct('p', {name}, 'n', {name}_n, 'o', {name}_o)), q -> transform(
        transform(sequence(1, size(q.p) - 2, 2), i -> named_struct('start', {before}, 'm', q.p[i], 'l', right(q.p[i - 1], 24), 'r', left(q.p[i + 1], 1))),
        x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.start + length(x.m), 'm', x.m, 'l', x.l, 'r', x.r, 'ok', {ok}, 'loose', {loose})))[0]
        ELSE CAST(array() AS {_SPAN}) END""")


def _before_blocks(name: str) -> Column:
    """Of lengths `name`_n, the sum of all before each block of STRIDE."""
    sums = f"transform(array({name}_n), n -> transform(sequence(0, CAST(size(n) / {STRIDE} AS INT)), b -> aggregate(slice(n, b * {STRIDE} + 1, {STRIDE}), 0, (a, x) -> a + x)))"
    return F.expr(f"CASE WHEN size({name}_n) > {STRIDE} THEN transform({sums}, s -> transform(sequence(0, size(s) - 1), b -> aggregate(slice(s, 1, b), 0, (a, x) -> a + x)))[0] WHEN {name}_n IS NOT NULL THEN array(0) END")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: From the last digit on, every second one is doubled, less 9 if over 9; the sum is a multiple of 10.
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> CAST(c AS INT) * (1 + i % 2) - CASE WHEN i % 2 = 1 AND CAST(c AS INT) > 4 THEN 9 ELSE 0 END), 0, (a, d) -> a + d) % 10 = 0"


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, _row (all columns), _t and the arrays base (with `ok`) and loose."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\1")).otherwise(text).alias("_t"))
    digit, at = F.col("_digit"), F.contains("_t", F.lit("@"))
    out = out.select("doc_id", "_row", "_t", F.col("_t").rlike("[0-9]").alias("_digit"))
    spelt = at | F.col("_t").rlike(r"(?i)[\[({ ]at[\])} ]")
    pieces = {"p0": (EMAIL, at), "p1": (IP, digit), "p2": (CARD, digit), "p3": (PHONE, digit & F.contains("_t", F.lit("+"))), "q0": (LOOSE_EMAIL, spelt), "q1": (LOOSE_IP, F.contains("_t", F.lit(":"))), "q3": (LOOSE_PHONE, digit)}
    out = out.select("doc_id", "_row", "_t", *(_pieces(*p).alias(n) for n, p in pieces.items()))
    out = out.select("doc_id", "_row", "_t", *pieces, *(F.expr(f"transform({n}, x -> length(x))").alias(f"{n}_n") for n in pieces))
    out = out.select("*", *(_before_blocks(n).alias(f"{n}_o") for n in pieces))
    checks = {"p0": "true", "p1": f"x.m RLIKE '{VALID_IP}'".replace("\\", "\\\\"), "p2": _LUHN, "p3": f"length({_DIGITS}) BETWEEN 10 AND 15"}
    base = F.concat(*(_spans(n, k, checks[n], 0) for k, n in enumerate(("p0", "p1", "p2", "p3"))))
    loose = F.concat(*(_spans(n, k, "false", 1) for n, k in (("q0", 0), ("q1", 1), ("q3", 3))))
    return out.select("doc_id", "_row", "_t", base.alias("base"), loose.alias("loose"))


def _edge(char: str) -> str:
    return f"CASE WHEN {char} = '' THEN 0 WHEN {char} RLIKE '\\\\s' THEN 1 WHEN {char} RLIKE '[\\\\p{{L}}\\\\p{{N}}]' THEN 2 ELSE 3 END"


def _vector(x: str) -> dict[str, str]:
    """SQL of each feature of a span: a whole number below its entry in FEATURES."""
    digits = f"length(regexp_replace({x}.m, '[^0-9]', ''))"
    return {
        "kind": f"{x}.kind",
        "loose": f"{x}.loose",
        "digits": f"CASE WHEN {digits} = 0 THEN 0 WHEN {digits} < 10 THEN 1 WHEN {digits} < 13 THEN 2 WHEN {digits} < 16 THEN 3 WHEN {digits} = 16 THEN 4 ELSE 5 END",
        "marks": f"least(length(regexp_replace({x}.m, '[0-9A-Za-z]', '')), 6)",
        "size": f"least(CAST(length({x}.m) / 6 AS INT), 6)",
        "before": _edge(f"right({x}.l, 1)"),
        "after": _edge(f"{x}.r"),
    }


def _announced(x: str) -> str:
    """SQL: a keyword of its own kind stands right before the span."""
    return "(" + " OR ".join(f"{x}.kind = {k} AND {x}.l RLIKE '(?i)(?:^|[^a-z])(?:{words})[^A-Za-z0-9]{{0,4}}$'" for k, words in enumerate(KEYWORDS)) + ")"


class Trees:
    """Boosted trees over counted feature vectors, as SQL."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]]):
        """rows: (vector, spans, valid spans)."""
        names = list(FEATURES)
        total, valid = sum(n for _, n, _ in rows), sum(v for _, _, v in rows)
        prior = (valid + 1) / (total + 2)
        self.bias = round(math.log(prior / (1 - prior)), 9)
        self.trees: list[str] = []
        self.steps: list = []
        raw = [self.bias] * len(rows)

        def leaf(some: list[int]) -> tuple[float, float, float]:
            g = sum(rows[i][2] - rows[i][1] / (1 + math.exp(-raw[i])) for i in some)
            p = [1 / (1 + math.exp(-raw[i])) for i in some]
            h = sum(rows[i][1] * q * (1 - q) for i, q in zip(some, p, strict=True)) + RIDGE
            return g * g / h, g / h, h

        def best(some: list[int]) -> tuple[float, int, int]:
            found = (1e-6, -1, 0)
            own = leaf(some)[0]
            for f, name in enumerate(names):
                for v in range(FEATURES[name] - 1):
                    left = [i for i in some if rows[i][0][f] <= v]
                    if left and len(left) < len(some):
                        right = [i for i in some if rows[i][0][f] > v]
                        found = max(found, (leaf(left)[0] + leaf(right)[0] - own, f, v))
            return found

        def grow(some: list[int], depth: int):
            """A tree's SQL, and the same as a function of vectors."""
            _, f, v = best(some) if depth else (0, -1, 0)
            if f < 0:
                step = round(RATE * leaf(some)[1], 9)
                for i in some:
                    moved[i] = step
                return f"{step:.9f}D", lambda vector: step
            left, right = (grow([i for i in some if (rows[i][0][f] <= v) == low], depth - 1) for low in (True, False))
            return f"(CASE WHEN v.{names[f]} <= {v} THEN {left[0]} ELSE {right[0]} END)", lambda vector: (left if vector[f] <= v else right)[1](vector)

        for _ in range(ROUNDS if rows else 0):
            moved = [0.0] * len(rows)
            sql, step = grow(list(range(len(rows))), 2)
            self.trees.append(sql)
            self.steps.append(step)
            raw = [a + b for a, b in zip(raw, moved, strict=True)]
    @staticmethod
    def thresholds(rows: list[tuple[int, int, float, float, float]]) -> list[float]:
        """rows: kind, loose, probability, spans, confirmed spans.  For each kind and generator (2 * kind + loose) the lowest
        probability from which on enough spans are confirmed, 0.5 at least; 2 where none is labelled."""
        out = []
        for group in range(2 * len(KINDS)):
            by: dict[float, list[float]] = {}
            for kind, loose, p, n, v in rows:
                if 2 * kind + loose == group:
                    sums = by.setdefault(round(p, 9), [0.0, 0.0])
                    sums[0] += n
                    sums[1] += v
            spans = good = 0.0
            least = 2.0
            for p in sorted(by, reverse=True):
                spans, good = spans + by[p][0], good + by[p][1]
                if good and good >= PRECISION * spans:
                    least = p
            out.append(max(least, 0.5))
        return out

    def rate(self, vector: tuple[int, ...]) -> float:
        """A vector's probability."""
        raw = self.bias + sum(step(vector) for step in self.steps)
        return 1 / (1 + math.exp(-raw))

    def probability(self) -> str:
        """SQL of a vector v's probability."""
        return f"1D / (1D + exp(-({' + '.join([f'{self.bias:.9f}D', *self.trees])})))"


_OVER = "b.start < x.end AND x.start < b.end"


def _learn(found: DataFrame) -> tuple[Trees, list[float]]:
    """Trees of one half of the documents and thresholds of the other."""
    half = F.pmod(F.xxhash64("doc_id", "_t"), F.lit(2)).cast("int").alias("_half")
    label = f"CASE WHEN exists(base, b -> {_OVER} AND b.ok AND b.kind = x.kind) THEN 1 WHEN exists(base, b -> {_OVER}) THEN 0 WHEN {_announced('x')} THEN 1 END"
    own = "transform(base, x -> named_struct('x', x, 'ok', CAST(x.ok AS INT)))"
    others = f"transform(loose, x -> named_struct('x', x, 'ok', {label}))"
    spans = found.where("size(base) > 0 OR size(loose) > 0").select(half, F.explode(F.expr(f"concat({own}, {others})")).alias("s")).where("s.ok IS NOT NULL").select("_half", "s.x", "s.ok")
    vectors = spans.select("_half", *(F.expr(sql).cast("int").alias(n) for n, sql in _vector("x").items()), "ok")
    rows = vectors.groupBy("_half", *FEATURES).agg(F.count("*").alias("_spans"), F.sum("ok").alias("_valid")).collect()
    counted = sorted((r["_half"], tuple(r[n] for n in FEATURES), float(r["_spans"]), float(r["_valid"])) for r in rows)
    trees = Trees([r[1:] for r in counted if r[0] == 0])
    return trees, Trees.thresholds([(v[0], v[1], trees.rate(v), n, good) for h, v, n, good in counted if h == 1])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _row (all columns), _t (the text), base and spans: arrays of (start, kind, end), sorted; ends are exclusive."""
    found = _matches(docs)
    trees, thresholds = _learn(found)
    fields = ", ".join(f"'{n}', {sql}" for n, sql in _vector("x").items())
    low = "array(" + ", ".join(f"{t:.9f}D" for t in thresholds) + ")"
    rated = f"named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'least', {low}[2 * x.kind + x.loose], 'p', round(transform(array(named_struct({fields})), v -> {trees.probability()})[0], 9))"
    plain = "transform({}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    out = found.select("doc_id", "_row", "_t", F.expr(f"array_sort({plain.format('filter(base, x -> x.ok)')})").alias("base"), F.expr("concat(filter(base, x -> NOT x.ok), loose)").alias("_rest"))
    more = f"filter(transform(filter(_rest, x -> NOT exists(base, b -> {_OVER})), x -> {rated}), x -> x.p >= x.least)"
    # In order of starts a candidate that overlaps the last one kept replaces it if it is likelier.
    kind = "array<struct<start:int,kind:int,end:int,least:double,p:double>>"
    apart = f"""aggregate(array_sort({more}), CAST(array() AS {kind}), (a, x) -> CASE WHEN size(a) = 0 OR a[size(a) - 1].end <= x.start THEN concat(a, array(x))
        WHEN x.p > a[size(a) - 1].p THEN concat(slice(a, 1, size(a) - 1), array(x)) ELSE a END)"""
    extra = F.expr(f"CASE WHEN size(_rest) > 0 THEN {plain.format(apart)} ELSE CAST(array() AS {_PLAIN}) END")
    out = out.select("doc_id", "_row", "_t", "base", extra.alias("_more"))
    return out.select("doc_id", "_row", "_t", "base", F.expr("CASE WHEN size(_more) > 0 THEN array_sort(concat(base, _more)) ELSE base END").alias("spans"))


def _listed(column: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the SHA-256 of their list, and the list of all spans."""
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_spans(docs).select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with their columns; each stretch of spans in text is replaced by its first kind in brackets, and n_chars,
    where there is one, follows.  A null text stays null, one without spans unchanged."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # Overlapping spans are one stretch: those that start before the last end only move that end.
    text = F.expr(f"""CASE WHEN size(spans) = 0 THEN _row.text ELSE aggregate(spans, named_struct('out', '', 'at', 0),
        (a, x) -> CASE WHEN x.start >= a.at THEN named_struct('out', concat(a.out, substring(_t, a.at + 1, x.start - a.at), {names}[x.kind]), 'at', x.end)
                       ELSE named_struct('out', a.out, 'at', greatest(a.at, x.end)) END,
        a -> concat(a.out, substring(_t, a.at + 1))) END""")
    out = find_spans(docs).select("_row", text.alias("_new"))
    changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns))
