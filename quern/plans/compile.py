"""From a prepared query to Columns: scores, reasons and predicates over a relation of search documents."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from quern.functions import text as T
from quern.plans.language import Branch, Filters, Prepared, Term

# Scores of fields (exact, contained), boosts and orders of media types, least score.
SCORES = {"title": (1000, 780), "snippet": (0, 620), "body": (0, 520), "alias": (540, 420), "sourceName": (920, 120), "displaySourceName": (920, 120), "url": (0, 360)}
DATELINE = 180
#: Media types of each tab, and what an exactly named source's documents gain.
TABS = {"image": ("image",), "pdf": ("pdf",), "article": ("article",), "video": ("video", "broadcast")}
PROMOTION = 2
BOOSTS = {"article": 260, "pdf": 180, "broadcast": 120, "image": 0, "video": 0}
PRIORITY = {"article": 1, "pdf": 2, "image": 3, "video": 4, "broadcast": 5}
MINIMUM = 100
#: Texts that a stored search result brings with it.
STORED = ("searchSnippet", "searchBody", "previewText")
URLS = ("url", "archiveUrl", "cachedUrl", "thumbnailUrl", "cachedThumbnailUrl")


def needed(q: Prepared) -> set[str]:
    """The forms that a query's score and exclusions read."""
    out: set[str] = set()
    e = q.excluded
    if e.generic or any(b.terms or b.phrases or b.groups for b in q.branches):
        out |= {"_title", "_snippet", "_dateline", "_body", "_sourceName", "_displaySourceName", "_aliases"}
    if e.title or any(b.title for b in q.branches):
        out.add("_title")
    if e.text or any(b.text for b in q.branches):
        out |= {"_title", "_snippet", "_dateline", "_body", *(f"_{c}" for c in STORED)}
    if e.url or any(b.url for b in q.branches):
        out.add("_urls")
    return out or {"_title"}


def with_fields(docs, fields: set[str] | None = None):
    """Documents with their comparable forms, computed once: title, snippet and body (without datelines, focused), aliases,
    source names, URLs, and the texts of stored results.  The forms come out of a generator of one row: filters and
    projections above it can't be pushed below, where each mention would compute the form again."""
    have = set(docs.columns)
    texts = {f"_{c}": F.col(c) for c in ("title", "sourceName", "displaySourceName", *STORED) if c in have}
    texts |= {"_snippet": T.without_dateline(F.col("snippet")), "_dateline": F.col("snippet"), "_body": T.focused(F.col("body"))}
    wanted = [k for k in texts if fields is None or k in fields]
    # Compact forms first, in a projection of their own: both forms of a field come from them.
    docs = docs.select("*", *(F.lower(T.compact(F.coalesce(texts[k], F.lit("")))).alias(f"_tight{k}") for k in wanted))
    own = lambda c: T.token(F.coalesce(F.col(c), F.lit("")))
    none = F.struct(F.lit("").alias("lower"), F.lit("").alias("compactLower"))
    forms = {k: F.struct(T.unmarked(F.col(f"_tight{k}")).alias("lower"), F.col(f"_tight{k}").alias("compactLower")) for k in wanted}
    forms |= {f"_{c}": none for c in ("title", "sourceName", "displaySourceName", *STORED) if c not in have}
    forms["_aliases"] = F.transform(F.col("aliases"), T.token) if "aliases" in have else F.array().cast("array<struct<lower:string,compactLower:string>>")
    forms["_urls"] = F.array(*(own(u) for u in URLS if u in have))
    out = docs.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in forms.items() if fields is None or k in fields)))))
    return out.drop(*(f"_tight{k}" for k in wanted))


def _contains(field: Column, term: Term) -> Column:
    marked = field["compactLower"].contains(term.compact_lower)
    return marked if term.marks else marked | field["lower"].contains(term.lower)


def field_score(field: Column, term: Term, name: str) -> Column:
    """Exact, contained or 0."""
    exact, contained = SCORES[name]
    hit = F.when(_contains(field, term), contained).otherwise(0)
    if not exact:
        return hit
    same = field["compactLower"] == term.compact_lower
    if not term.marks:
        same |= field["lower"] == term.lower
    return F.when((field["compactLower"] != "") & same, exact).otherwise(hit)


def _fields(term: Term) -> Column:
    """The best field and its name: struct(value, place, reason); the first of equals."""
    snippet = F.greatest(field_score(F.col("_snippet"), term, "snippet"), F.when(_contains(F.col("_dateline"), term), DATELINE).otherwise(0))
    alias = F.coalesce(F.array_max(F.transform("_aliases", lambda a: field_score(a, term, "alias"))), F.lit(0))
    scores = [("title", field_score(F.col("_title"), term, "title")), ("snippet", snippet), ("body", field_score(F.col("_body"), term, "body")), ("alias", alias), *((n, field_score(F.col(f"_{n}"), term, n)) for n in ("sourceName", "displaySourceName"))]
    return F.array_max(F.array(*(F.struct(s.alias("value"), F.lit(-k).alias("place"), F.lit(n).alias("reason")) for k, (n, s) in enumerate(scores))))


def _alias_has(term: Term) -> Column:
    return F.exists("_aliases", lambda a: _contains(a, term))


def _url(term: Term) -> Column:
    return F.coalesce(F.array_max(F.transform("_urls", lambda u: field_score(u, term, "url"))), F.lit(0))


def _rounded_mean(values: list[Column]) -> Column:
    return F.floor(reduce(lambda a, b: a + b, values) / len(values) + 0.5).cast("int")


def _all_positive(values: list[Column], then: Column) -> Column:
    return F.when(reduce(and_, (v > 0 for v in values)), then).otherwise(0)


def branch_score(b: Branch) -> Column:
    """Requirements first (URL, title, text), then phrases, then groups of terms, else the best field of any term."""
    need = [_url(t) > 0 for t in b.url] + [field_score(F.col("_title"), t, "title") > 0 for t in b.title]
    need += [reduce(or_, (_contains(F.col(f), t) for f in ("_snippet", "_body", *(f"_{c}" for c in STORED)))) for t in b.text]
    if b.url and not b.terms:
        scores = [_url(t) for t in b.url]
        value = _all_positive(scores, _rounded_mean(scores))
    elif b.phrases:
        scores = [_fields(t)["value"] for t in b.phrases]
        value = _all_positive(scores, _rounded_mean(scores) + min(160, 60 * (len(scores) - 1)))
    elif len(b.groups) > 1:
        scores = [F.greatest(*(_fields(t)["value"] for t in g), F.lit(0)) for g in b.groups]
        multi = _rounded_mean(scores) + min(220, 80 * (len(scores) - 1))
        whole = [_fields(t)["value"] for t in b.terms if t.kind != "split"]
        value = _all_positive(scores, F.greatest(multi, *whole) if whole else multi)
    elif b.terms:
        value = F.greatest(*(_fields(t)["value"] for t in b.terms), F.lit(0))
    else:
        value = F.lit(0)
    return F.when(reduce(and_, need), value).otherwise(0) if need else value


def base_score(q: Prepared) -> Column:
    """The best alternative's score; 0 for excluded documents; a source named exactly scores its fixed value."""
    best = F.greatest(*(branch_score(b) for b in q.branches), F.lit(0)) if q.branches else F.lit(0)
    if q.exact_source:
        best = F.when(F.col("sourceId") == q.exact_source, F.greatest(best, F.lit(SCORES["sourceName"][0]))).otherwise(best)
    out = excluded(q)
    return best if out is None else F.when(out, 0).otherwise(best)


def excluded(q: Prepared) -> Column | None:
    """Whether any exclusion of the query matches."""
    e = q.excluded
    parts = [_contains(F.col(f), t) for t in e.generic for f in ("_title", "_snippet", "_body", "_sourceName", "_displaySourceName")]
    parts += [_alias_has(t) for t in e.generic]
    parts += [_contains(F.col("_title"), t) for t in e.title]
    parts += [_contains(F.col(f), t) for t in e.text for f in ("_title", "_snippet", "_body")]
    parts += [_url(t) > 0 for t in e.url]
    return reduce(or_, parts) if parts else None


def reason(q: Prepared) -> Column:
    """The field that scores best for the first alternative's first term."""
    terms = [t for b in q.branches for t in b.terms]
    return _fields(terms[0])["reason"] if terms else F.lit("")


def predicate(f: Filters, sources: bool = True, columns: tuple[str, ...] = ()) -> Column:
    """Structured filters.  An empty date fails a lower bound and passes an upper one; a document that names its tabs
    (searchTabs, where `columns` has it) is on these only."""
    parts = [F.lit(True)]
    for name, values in (("mediaType", f.media), ("sourceType", f.source_types), ("language", f.languages)):
        if values:
            parts.append(F.col(name).isin(*values))
    for name, values in (("mediaType", f.not_media), ("language", f.not_languages)):
        if values:
            parts.append(~F.col(name).isin(*values))
    if sources and f.sources:
        parts.append(F.col("sourceId").isin(*f.sources))
    if f.not_sources:
        parts.append(~F.col("sourceId").isin(*f.not_sources))
    if f.date_from:
        parts.append(F.col("date") >= f.date_from)
    if f.date_to:
        parts.append(F.col("date") <= f.date_to)
    if f.tab != "all":
        parts.append(F.col("mediaType").isin(*TABS.get(f.tab, (f.tab,))))
        if "searchTabs" in columns:
            parts.append((F.coalesce(F.size("searchTabs"), F.lit(0)) <= 0) | F.array_contains("searchTabs", f.tab))
    return reduce(and_, parts)


def boosted(score: Column, tab: str) -> Column:
    """The score with the media type's boost, on the tab of everything."""
    if tab != "all":
        return score
    return score + F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in BOOSTS.items() for x in p)), F.col("mediaType")), F.lit(0))


def priority(column: str = "mediaType") -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p)), F.col(column)), F.lit(9))
