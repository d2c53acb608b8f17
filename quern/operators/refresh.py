"""Refresh policies of sources and rate-limited appends: what is live, what is kept, what is tried again."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.plans.language import Filters

# Least results without a live supplement, limits of an article's comments, life of a refresh.
LEAST_RESULTS = 12
ARTICLE_LIMIT, ARTICLE_SECONDS, ARTICLE_CAPACITY = 60, 600, 1000
REFRESH_SECONDS, POSTS = 300, 120
RANKING_THRESHOLD = 0.2


def eligible(catalogue: list[str], included: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> list[str]:
    """Live sources that a query may ask, in catalogue order."""
    return [s for s in catalogue if (not included or s in included) and s not in excluded]


def supplements(total: int, query: str, f: Filters, live: list[str], language: str = "ko") -> bool:
    """Whether live results are added: few results, the first page of a tab that shows them, a text to look for, a live
    source among those asked, and its language not ruled out."""
    return bool(total < LEAST_RESULTS and f.tab in ("all", "image") and not f.offset and query.strip() and eligible(live, f.sources, f.not_sources) and (not f.languages or language in f.languages) and language not in f.not_languages)


def scoped(df: DataFrame, included: list[str] = (), excluded: list[str] = (), column: str = "sourceId") -> DataFrame:
    """Rows of the included sources (of all, if none is named) without the excluded ones."""
    out = df.where(F.col(column).isin(*included)) if included else df
    return out.where(~F.col(column).isin(*excluded)) if excluded else out


def search_urls(df: DataFrame, templates: str = "templates", queries: str = "queries", column: str = "sourceId") -> DataFrame:
    """Distinct (column, url) of each row's absolute templates with each of its queries: in place of {query} as a component, else
    as parameter s.  Fragments go, white space in queries becomes one space, blank templates and queries give nothing."""
    t, q = F.col("_t"), F.trim(F.regexp_replace("_q", "\\s+", " "))
    form, part = F.url_encode(q), F.url_encode(q)
    # What a component leaves as it is, and a form does not.
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        part = F.replace(part, F.lit(code), F.lit(plain))
    bare = F.regexp_replace(t, "#.*$", "")
    asked = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("s="), form)
    url = F.when(F.contains(t, F.lit("{query}")), F.regexp_replace(F.replace(t, F.lit("{query}"), part), "#.*$", "")).otherwise(asked)
    pairs = df.select(column, F.explode(templates).alias("_t"), F.col(queries).alias("_qs")).select(column, "_t", F.explode("_qs").alias("_q"))
    return pairs.where((F.trim(t) != "") & (q != "")).select(column, url.alias("url")).distinct()


def options(*layers: dict) -> dict:
    """Effective options: each from the first layer that states it; null states nothing."""
    return {k: v for layer in reversed(layers) for k, v in layer.items() if v is not None}


def stored_config(source: dict, runtime: tuple[str, ...] = ("crawler", "fetch", "selectors")) -> dict:
    """A source without what only a run needs."""
    return {k: v for k, v in source.items() if k not in runtime}


def preview_limit(groups: int, total: int) -> int:
    """Results that a group shows: fewer where there are more groups."""
    if groups <= 1:
        return min(12, max(8, total))
    return min(8, max(5, total)) if groups <= 3 else 5


def ranking_threshold(value) -> float | None:
    """A threshold between 0 and 1; None switches it off, what is no number means the default."""
    if value is None:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return RANKING_THRESHOLD
    return min(1.0, max(0.0, number)) if number == number and abs(number) != float("inf") else RANKING_THRESHOLD


def route(query: str, f: Filters) -> str:
    """The canonical URL query of a search: fixed order, defaults left out."""
    lists = [("media", f.media), ("lang", f.languages), ("source", f.sources), ("notMedia", f.not_media), ("notLang", f.not_languages), ("notSource", f.not_sources)]
    parts = [("q", query.strip()), ("tab", "" if f.tab == "all" else f.tab), ("sort", "" if f.sort == "relevance" else f.sort)]
    parts += [(k, ",".join(dict.fromkeys(v))) for k, v in lists] + [("from", f.date_from), ("to", f.date_to), ("page", str(f.offset // f.limit + 1) if f.offset else "")]
    return urlencode([(k, v) for k, v in parts if v])


def routed(url_query: str, limit: int = 50) -> tuple[str, Filters]:
    """The search of a URL query; what is unknown or no page number is left out."""
    found = dict(parse_qsl(url_query.lstrip("?")))
    many = lambda k: tuple(x for x in found.get(k, "").split(",") if x)
    page = int(found["page"]) if found.get("page", "").isdigit() and int(found["page"]) > 0 else 1
    return found.get("q", "").strip(), Filters(media=many("media"), not_media=many("notMedia"), languages=many("lang"), not_languages=many("notLang"), sources=many("source"), not_sources=many("notSource"), date_from=found.get("from", ""), date_to=found.get("to", ""), tab=found.get("tab", "all"), sort=found.get("sort", "relevance"), offset=(page - 1) * limit, limit=limit)


def last_known_good(old: DataFrame, new: DataFrame, failed: DataFrame, key: str = "sourceId") -> DataFrame:
    """New rows of the sources that were refreshed, old rows of those that failed or gave nothing; all of one form."""
    lost = old.join(new.select(key).distinct(), key, "left_anti").select(key).unionByName(failed.select(key)).distinct()
    return new.join(failed.select(key).distinct(), key, "left_anti").unionByName(old.join(lost, key, "left_semi"))


def reused(listing: DataFrame, known: DataFrame, as_of: str, days: int, key: str = "url") -> DataFrame:
    """A listing with `reuse`: its detail is known, of the same source, and dated before the last `days` days."""
    old = known.groupBy(key, "sourceId").agg(F.max("date").alias("_date"))
    limit = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    return listing.join(old, [key, "sourceId"], "left").withColumn("reuse", F.coalesce(F.col("_date") < limit, F.lit(False))).drop("_date")


def drained(queue: DataFrame, done: DataFrame, limit: int, at: str, key: str = "url") -> DataFrame:
    """What a deadline left in the queue, in its order and each once, up to a limit: these become listing rows."""
    rest = queue.groupBy(key).agg(F.min(at).alias(at)).join(done.select(key), key, "left_anti")
    return rest.orderBy(at, key).limit(limit)


def article_attempts(events: DataFrame, article: str = "article", ts: str = "ts") -> DataFrame:
    """Events with `allowed`: fewer than the limit of earlier ones of the same article in the window, and fewer than its capacity in all."""
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(article).orderBy(second)
    recent = F.count("*").over(by.rangeBetween(-ARTICLE_SECONDS * 1_000_000, -1))
    ever = F.count("*").over(by.rangeBetween(Window.unboundedPreceding, -1))
    return events.select("*", recent.alias("recent"), ever.alias("ever")).withColumn("allowed", (F.col("recent") < ARTICLE_LIMIT) & (F.col("ever") < ARTICLE_CAPACITY))


class Conflict(Exception):
    """The value changed under every attempt."""


def compare_and_set(read, write, change, attempts: int = 8):
    """read() -> (value, tag); write(value, tag) -> False if the tag is no longer current; change(value) -> new value, or None to
    leave it.  Tries again on what is current then."""
    for _ in range(attempts):
        value, tag = read()
        new = change(value)
        if new is None or write(new, tag):
            return value if new is None else new
    raise Conflict(attempts)


@dataclass
class Memo:
    """Results of refreshes, failures included, for REFRESH_SECONDS; the oldest go beyond POSTS."""

    clock: object
    kept: dict = field(default_factory=dict)

    def get(self, key, load):
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < REFRESH_SECONDS:
            _, value, error = self.kept[key]
        else:
            value, error = None, None
            try:
                value = load()
            except Exception as e:  # a failure is kept like a result, and raised to every caller
                error = e
            self.kept.pop(key, None)
            self.kept[key] = (now, value, error)
            while len(self.kept) > POSTS:
                del self.kept[next(iter(self.kept))]
        if error is not None:
            raise error
        return value


def stable_json(text: str) -> str:
    """JSON with the keys of all objects in order, at any depth, without spaces."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def by_key_function(df: DataFrame, key: Column, *aggregates: Column) -> DataFrame:
    """Aggregates by a caller's key expression, as `key`; without aggregates, counts."""
    return df.groupBy(key.alias("key")).agg(*(aggregates or (F.count("*").alias("n"),)))
