"""Search queries: each prepared query runs in Spark, and its SQL is written from the same plan by its own rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import DOCS, SOURCES, docs, query, sources, table
from quern.functions import text as T
from quern.operators import search as S
from quern.plans import compile as C
from quern.plans.language import Branch, Filters, Prepared, Term, prepare

#: Hosts and names for operators; a query's source operators are resolved on the driver.
KNOWN = [{"id": f"src{k}", "name": f"Source SRC{k}", "host": f"src{k}.example.org"} for k in range(20)]
SHOWN = ("id", "score", "baseScore", "sourceId", "mediaType", "date")

_WIDE, _PLAIN = T._WIDE, T._PLAIN.replace("'", "''")
_SPACES = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _compact(x: str) -> str:
    return f"lower(regexp_replace(translate({x}, '{_WIDE}', '{_PLAIN}'), '{_SPACES}', '', 'g'))"


def _simple(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(translate({x}, '{_WIDE}', '{_PLAIN}'), '{_SPACES}', '', 'g'), '[\\p{{P}}\\p{{S}}]+', '', 'g'))"


FIELDS = {"title": "title", "snippet": "snippet", "body": "left(left(body, 1750), 1400)", "sourceName": "sourceName", "url": "url"}
TOKENS = f"""{DOCS}, tokens AS (SELECT *, {', '.join(f"{_compact(x)} AS {n}_c, {_simple(x)} AS {n}_l" for n, x in FIELDS.items())} FROM docs)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(field: str, t: Term) -> str:
    return f"(contains({field}_c, {_q(t.compact_lower)}) OR contains({field}_l, {_q(t.lower)}))"


def _score(field: str, t: Term) -> str:
    exact, hit = C.SCORES[field]
    first = f"WHEN {field}_c <> '' AND ({field}_c = {_q(t.compact_lower)} OR {field}_l = {_q(t.lower)}) THEN {exact} " if exact else ""
    return f"CASE {first}WHEN {_has(field, t)} THEN {hit} ELSE 0 END"


def _best(t: Term) -> str:
    return "greatest(" + ", ".join(_score(f, t) for f in ("title", "snippet", "body", "sourceName")) + ")"


def _mean(values: list[str], bonus: int) -> str:
    return f"CASE WHEN {' AND '.join(f'({v}) > 0' for v in values)} THEN CAST(floor(({' + '.join(f'({v})' for v in values)}) / {float(len(values))} + 0.5) AS INTEGER) + {bonus} ELSE 0 END"


def _branch(b: Branch) -> str:
    need = [f"({_score('url', t)}) > 0" for t in b.url] + [f"({_score('title', t)}) > 0" for t in b.title] + [f"({_has('snippet', t)} OR {_has('body', t)})" for t in b.text]
    if b.url and not b.terms:
        value = _mean([_score("url", t) for t in b.url], 0)
    elif b.phrases:
        value = _mean([_best(t) for t in b.phrases], min(160, 60 * (len(b.phrases) - 1)))
    elif len(b.groups) > 1:
        each = ["greatest(" + ", ".join(_best(t) for t in g) + ")" for g in b.groups]
        whole = [_best(t) for t in b.terms if t.kind != "split"]
        value = f"CASE WHEN {' AND '.join(f'({v}) > 0' for v in each)} THEN greatest({', '.join([_mean(each, min(220, 80 * (len(each) - 1))), *whole])}) ELSE 0 END"
    else:
        value = "greatest(" + ", ".join(_best(t) for t in b.terms) + ")" if b.terms else "0"
    return f"CASE WHEN {' AND '.join(need)} THEN {value} ELSE 0 END" if need else value


def _excluded(q: Prepared) -> str:
    e = q.excluded
    parts = [_has(f, t) for t in e.generic for f in ("title", "snippet", "body", "sourceName")] + [_has("title", t) for t in e.title]
    parts += [_has(f, t) for t in e.text for f in ("title", "snippet", "body")] + [_has("url", t) for t in e.url]
    return " OR ".join(parts) or "FALSE"


def _filters(f: Filters, with_sources: bool = True) -> str:
    inside = lambda c, v, no="": f"{c} {no}IN ({', '.join(map(_q, v))})"
    parts = ["TRUE"]
    parts += [inside(c, v) for c, v in (("mediaType", f.media), ("sourceType", f.source_types), ("language", f.languages)) if v]
    parts += [inside(c, v, "NOT ") for c, v in (("mediaType", f.not_media), ("language", f.not_languages), ("sourceId", f.not_sources)) if v]
    parts += [inside("sourceId", f.sources)] if f.sources and with_sources else []
    parts += [f"date >= {_q(f.date_from)}"] if f.date_from else []
    parts += [f"date <= {_q(f.date_to)}"] if f.date_to else []
    parts += [inside("mediaType", {"video": ("video", "broadcast")}.get(f.tab, (f.tab,)))] if f.tab != "all" else []
    return " AND ".join(parts)


def _order(q: Prepared) -> str:
    rank = "list_position(['article', 'pdf', 'image', 'video', 'broadcast'], mediaType)"
    if q.filters.sort == "latest":
        return f"date DESC, {rank}, score DESC, title, id"
    return f"score DESC, {rank}, date DESC, id" if q.branches else f"{rank}, date DESC, title, id"


def found_sql(q: Prepared, with_sources: bool = True) -> str:
    """CTEs up to `found`: scored, collapsed and filtered rows."""
    base = "greatest(" + ", ".join([_branch(b) for b in q.branches] + ["0"]) + ")" if q.branches else "0"
    if q.exact_source:
        base = f"CASE WHEN sourceId = {_q(q.exact_source)} THEN greatest({base}, 920) ELSE {base} END"
    boost = "CASE mediaType WHEN 'article' THEN 260 WHEN 'pdf' THEN 180 WHEN 'broadcast' THEN 120 ELSE 0 END" if q.filters.tab == "all" and q.branches else "0"
    least = f"WHERE baseScore >= {C.MINIMUM}" if q.branches else ""
    key = "CASE WHEN mediaType IN ('article', 'pdf', 'broadcast') THEN concat_ws(chr(10), sourceId, mediaType, date, regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '', 'g')) ELSE 'id' || CAST(id AS VARCHAR) END"
    return f"""WITH {TOKENS}, based AS (SELECT *, CAST(CASE WHEN {_excluded(q)} THEN 0 ELSE {base} END AS INTEGER) AS baseScore FROM tokens),
scored AS (SELECT *, CAST(baseScore + {boost} AS INTEGER) AS score FROM based {least}),
first AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_order(q)}) AS n FROM scored),
found AS (SELECT * FROM first WHERE n = 1 AND {_filters(q.filters, with_sources)})"""


def search_sql(q: Prepared, limit: bool = False) -> str:
    page = f" ORDER BY {_order(q)} LIMIT {q.filters.limit} OFFSET {q.filters.offset}" if limit else ""
    return f"{found_sql(q)} SELECT {', '.join(SHOWN)} FROM found{page}"


def _register(name: str, text: str, filters: Filters = Filters(), paged: bool = False) -> None:
    plan = prepare(text, KNOWN, filters)

    @query(name, search_sql(plan, paged))
    def run(spark, sf_dir):
        found = S.search(docs(spark, sf_dir), plan)
        return (S.page(found, plan, bool(plan.branches)) if paged else found).select(*SHOWN)


_register("search_and_terms", "the and")
_register("search_single_term", "thin")
_register("search_phrase", '"of the"')
_register("search_two_phrases", '"of the" "in a"')
_register("search_or_branches", "thetion OR tionand | withre")
_register("search_or_group", "(thetion OR leeau) and")
_register("search_exclude", "the -with")
_register("search_not_operator", "the NOT with")
_register("search_exclude_phrase", 'the -"of the"')
_register("search_title_scope", "intitle:the and")
_register("search_title_exclude", "the -intitle:and")
_register("search_text_scope", "intext:with")
_register("search_url_scope", "inurl:src1 the")
_register("search_url_only", "allinurl: src3 example")
_register("search_all_title", "allintitle: the and")
_register("search_structured_filter", "the lang:en filetype:article site:src5.example.org")
_register("search_site_suffix", "the site:example.org -site:src2.example.org")
_register("search_source_operator", "the source:src4")
_register("search_exact_source", "Source SRC7")
_register("search_negative_filters", "the -lang:en -filetype:video")
_register("search_filter_only", "lang:fr filetype:pdf")
_register("search_date_range", "the date:2024-02..2024-04")
_register("search_after_before", "the after:2024-03 before:2024-05-15")
_register("search_korean_operators", "제목:the 언어:영어 기간:2024년")
_register("search_tab", "the", Filters(tab="pdf"))
_register("search_latest_sort", "the and", Filters(sort="latest", limit=30), paged=True)
_register("search_page_2", "the", Filters(offset=20, limit=20), paged=True)
_register("search_top_20", "the and", Filters(limit=20), paged=True)
_register("search_entity", "Apache License")
_register("search_filter_page", "lang:de", Filters(limit=25), paged=True)

_COLLAPSE = prepare("the", KNOWN)


@query("search_collapse_story", f"{found_sql(_COLLAPSE)} SELECT id, title FROM found")
def search_collapse_story(spark, sf_dir):
    return S.search(docs(spark, sf_dir), _COLLAPSE).select("id", "title")


@query("search_collapse_nfkc")
def search_collapse_nfkc(spark, sf_dir):
    """The collapse with the full compatibility key, which SQL lacks."""
    found = S.scored(docs(spark, sf_dir), _COLLAPSE)
    return S.collapsed(found, S.order(_COLLAPSE), composed=False).select("id", "title")


@query("search_reason", f"""WITH {TOKENS} SELECT id, CASE WHEN title_s >= greatest(snippet_s, body_s, source_s) THEN 'title' WHEN snippet_s >= greatest(body_s, source_s) THEN 'snippet' WHEN body_s >= source_s THEN 'body' ELSE 'sourceName' END AS reason
FROM (SELECT id, {_score('title', Term('thin'))} AS title_s, {_score('snippet', Term('thin'))} AS snippet_s, {_score('body', Term('thin'))} AS body_s, {_score('sourceName', Term('thin'))} AS source_s FROM tokens) WHERE greatest(title_s, snippet_s, body_s, source_s) >= 100""")
def search_reason(spark, sf_dir):
    plan = prepare("thin", KNOWN)
    scored = C.with_fields(docs(spark, sf_dir)).withColumns({"_s": C.base_score(plan), "reason": C.reason(plan)})
    return scored.where("_s >= 100").select("id", "reason")


@query("facet_counts", f"{found_sql(_COLLAPSE)} SELECT sourceId, name, place, count(*) AS n FROM found LEFT JOIN (SELECT id AS sid, name, place FROM (WITH {SOURCES} SELECT * FROM sources)) ON sid = sourceId GROUP BY ALL")
def facet_counts(spark, sf_dir):
    return S.facets(S.search(docs(spark, sf_dir), _COLLAPSE), sources(spark, sf_dir))


_MULTI = prepare("the", KNOWN, Filters(sources=("src1", "src2")))


@query("facet_multiselect", f"{found_sql(_MULTI, with_sources=False)} SELECT sourceId, count(*) AS n FROM found GROUP BY 1")
def facet_multiselect(spark, sf_dir):
    """Facets ignore a source filter that was chosen among the facets."""
    found = S.collapsed(S.scored(docs(spark, sf_dir), _MULTI), S.order(_MULTI)).where(C.predicate(_MULTI.filters, sources=False))
    return S.facets(found)


@query("facet_merge_partial", f"WITH {DOCS} SELECT sourceId, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY 1")
def facet_merge_partial(spark, sf_dir):
    d = docs(spark, sf_dir)
    return S.merge_facets(S.facets(d.where("mediaType = 'article'")), S.facets(d.where("mediaType <> 'article'")))


_GROUPS = prepare("the and", KNOWN, Filters(limit=100))


@query("source_groups", f"""{found_sql(_GROUPS)}, page AS (SELECT * FROM found ORDER BY {_order(_GROUPS)} LIMIT 100)
SELECT sourceId, count(*) AS n, greatest(max(score), 0) AS best, max(date) AS latest, string_agg(CAST(id AS VARCHAR), ',' ORDER BY score DESC, id) AS ids FROM page GROUP BY 1""")
def source_groups(spark, sf_dir):
    page = S.page(S.search(docs(spark, sf_dir), _GROUPS), _GROUPS)
    return S.groups(page).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("search_excerpt", f"""WITH {DOCS} SELECT id, CASE WHEN strpos(lower(snippet), 'with') > 0 THEN substr(snippet, greatest(1, strpos(lower(snippet), 'with') - 63), 190) ELSE left(snippet, 190) END AS excerpt FROM docs""")
def search_excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("id", S.excerpt(F.col("snippet"), "with").alias("excerpt"))


@query("search_highlight", f"""WITH {DOCS}, parts AS (SELECT id, string_split(lower(snippet), 'with') AS p FROM docs),
hits AS (SELECT id, k, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 4 AS s FROM (SELECT id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM parts WHERE len(p) > 1) WHERE k <= 4)
SELECT docs.id, coalesce(string_agg(CAST(s AS INTEGER) || '-' || CAST(s + 4 AS INTEGER), ',' ORDER BY k), '') AS ranges FROM docs LEFT JOIN hits USING (id) GROUP BY 1""")
def search_highlight(spark, sf_dir):
    ranges = S.merged_ranges(S.highlight(F.col("snippet"), "with"))
    return docs(spark, sf_dir).select("id", F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("ranges"))


def _entries(spark, sf_dir):
    d = docs(spark, sf_dir)
    return S.dictionary(
        sources(spark, sf_dir).select(F.col("name").alias("label"), F.lit(False).alias("alias"), F.col("place").cast("long").alias("place")),
        sources(spark, sf_dir).select(F.col("id").alias("label"), F.lit(True).alias("alias"), F.col("place").cast("long").alias("place")),
        d.where("title <> ''").select(F.col("title").alias("label"), F.lit(False).alias("alias"), F.col("id").alias("place")),
    )


_DICT = f"""{DOCS}, {SOURCES}, parts AS (SELECT name AS label, FALSE AS alias, 0 AS part, CAST(place AS BIGINT) AS place FROM sources UNION ALL SELECT id, TRUE, 1, place FROM sources UNION ALL SELECT title, FALSE, 2, id FROM docs WHERE title <> ''),
entries AS (SELECT label, alias, part, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY part, place) AS n FROM parts) WHERE n = 1)"""


@query("suggest_dictionary", f"WITH {_DICT} SELECT label, alias, part, place FROM entries")
def suggest_dictionary(spark, sf_dir):
    return _entries(spark, sf_dir)


@query("suggest_titles", f"""WITH {_DICT} SELECT label, alias, place, score FROM (SELECT *, CASE WHEN lower(label) = 'source' THEN 120 WHEN starts_with(lower(label), 'source') THEN 105 WHEN starts_with(regexp_replace(lower(label), '\\s+', '', 'g'), 'source') THEN 104
WHEN contains(regexp_replace(lower(label), '\\s+', '', 'g'), 'source') THEN 92 ELSE 0 END - CASE WHEN alias THEN 8 ELSE 0 END AS score FROM entries) WHERE score > 0 ORDER BY score DESC, place, label LIMIT 8""")
def suggest_titles(spark, sf_dir):
    return S.suggestions(_entries(spark, sf_dir), "source").select("label", "alias", "place", "score")


@query("point_lookup", "SELECT doc_id AS id, lang FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select(F.col("doc_id").alias("id"), "lang").limit(1)
