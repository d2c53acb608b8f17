"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens of a page are its start tags with their path and its text blocks with their path.  Over the
pages of a host each token has an occurrence vector (how often it occurs in which page).  Pages whose
own text (what tag roles leave) is the same are copies and count as one.  Tokens that share the vector
form an equivalence class; a class that is large (several tokens) and frequent (half of the like pages,
and two at least) is valid.  Like pages are the host's, or, where a class of `GROUP_PAGES` pages lies in
one of them only, those of one first directory or of one layout of outer elements.

On each page the valid classes are nested into the template: the class of most tokens first, then each
that lies in one gap between neighbouring tokens of every class before it, or has that class in one gap of
its own; classes that cross are not part of the template there.  What lies between template tokens are
slots; text blocks that are template tokens are furniture.  Slots under elements of a boilerplate role
(menus, adverts, forms, comments ...) are left out as well; of the rest, those in article or main elements
are the text, or, in pages without such elements, those that are not mostly links.

Vectors are compared by an order-free hash, so the corpus is only counted per (host, token), with partial
sums before the shuffle: a host may hold any share of the pages, and html is not shuffled.  Templates of up
to `BROADCAST_TOKENS` tokens in all are broadcast; more are joined to the pages' tokens.

Defined results: a null, empty or text-less page has the empty text; a page whose slots are all template
tokens keeps them; a page without URL belongs to the host ''; broken and truncated markup is read as far as
it goes; very long pages are read whole; repeated rows and copies count once and are extracted alike; rows
keep their page_id, repeated or null; of classes of equal size the one that begins first is nested first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import chunked, mix
from quern.llm.tables import dealt_join, written

#: A class is valid from so many tokens and this share of a host's pages on.
CLASS_TOKENS, CLASS_SHARE = 3, 0.5
#: From so many distinct contents on a class is judged against a part of the host; depth of the elements that make a layout.
GROUP_PAGES, LAYOUT_DEPTH = 3, 3
#: Template tokens of all hosts (16 bytes each) up to which they are broadcast.
BROADCAST_TOKENS = 2 << 20

# HTML's element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math", "canvas", "audio", "video"}
ROLES = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
CLOSES = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
HOLDERS = {"article", "aside", "blockquote", "body", "div", "dl", "fieldset", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "tbody", "ul"}
#: Words of class, id and role attributes that name boilerplate.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
MAIN = {"article", "main"}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _boilerplate(name: str, attributes: str) -> bool:
    if name in ROLES:
        return True
    if "=" in attributes and name not in ("html", "body", "article", "main"):
        for m in _NAMED.finditer(attributes):
            if any(w.lower() in NAMES for w in _WORD.findall(m[1] or m[2] or m[3] or "")):
                return True
    return False


def events(page: str) -> list[tuple[int, int, tuple | None]]:
    """The page's tokens in order: (number, depth, None) of a start tag with its path, (number, depth, block) of a text
    block: text, boilerplate, in an article, share of link text."""
    out: list[tuple[int, int, tuple | None]] = []
    stack: list[tuple[str, int, bool, bool, bool]] = []  # name, path, boilerplate, article, link
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    linked = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                _, path, bad, main, _ = stack[-1] if stack else ("", 0, False, False, False)
                out.append((_key(f"{path} {text}"), len(stack), (text, bad, main, linked / len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    while at < size:
        m = _TAG.search(page, at)
        to = m.start() if m else size
        if to > at:
            text = entities.unescape(page[at:to])
            parts.append(text)
            if stack and stack[-1][4]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[1] or m[4]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        attributes = m[3] or m[6] or ""
        if (opened["p"] or name in CLOSES and opened[name]) and (name in CLOSES or (name not in INLINE and name not in VOID)):
            # A block ends an open paragraph, and a cell or item its like, with what is open inside.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name and name in CLOSES or stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in HOLDERS:
                    break
        above = stack[-1] if stack else ("", 0, False, False, False)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        path = _key(f"{above[1]}/{name}" + ("".join(sorted(x[1] or x[2] or x[3] or "" for x in _NAMED.finditer(attributes))) if "=" in attributes else ""))
        out.append((path, len(stack) + 1, None))
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE | HOLDERS:
            continue
        main = name in MAIN
        # Boilerplate that was never closed ends where an article begins.
        bad = not main and (above[2] or _boilerplate(name, attributes) or (name == "header" and not above[3]))
        stack.append((name, path, bad, above[3] or main, above[4] or name == "a"))
        opened[name] += 1
    flush()
    return out


def _slots(found: list[tuple[int, int, tuple | None]]) -> list[tuple[int, str]]:
    """Number and text of the blocks that tag roles leave."""
    texts = [(number, block) for number, _, block in found if block]
    inside = any(block[2] for _, block in texts)
    return [(number, text) for number, (text, bad, main, linked) in texts if not bad and (main if inside else linked <= 0.5)]


def nested(classes: list[int]) -> set[int]:
    """The classes (0: none) of a page's tokens that nest: each lies in one gap of every other or has the other in one of its own."""
    places: dict[int, list[int]] = defaultdict(list)
    for place, c in enumerate(classes):
        if c:
            places[c].append(place)
    kept: list[tuple[int, np.ndarray]] = []
    for c, own in sorted(places.items(), key=lambda x: (-len(x[1]), x[1][0])):
        mine = np.array(own)
        if all(len(np.unique(np.searchsorted(other, mine))) == 1 or len(np.unique(np.searchsorted(mine, other))) == 1 for _, other in kept):
            kept.append((c, mine))
    return {c for c, _ in kept}


def main_text(page: str, template) -> str:
    """The text of the page's slots; template: from a list of tokens' numbers to their classes, 0 where they have none."""
    found = events(page)
    numbers = [number for number, *_ in found]
    classes = template(numbers)
    kept = nested(classes)
    furniture = {number for number, c in zip(numbers, classes, strict=True) if c in kept}
    slots = _slots(found)
    own = [text for number, text in slots if number not in furniture]
    # A page is never all template.
    return " ".join(own or [text for _, text in slots])


def _parsed(batches):
    """Of each page its host and directory, layout, content (one number for all copies of a page's own text, whatever stands
    around it) and tokens with their times."""
    for batch in chunked(batches, "html"):
        lists = [[] for _ in range(4)]
        for text in batch.column(batch.schema.get_field_index("html")).to_pylist():
            found = events(text or "")
            counts = Counter(number for number, *_ in found)
            outer = sorted({number for number, depth, block in found if depth <= LAYOUT_DEPTH and block is None})
            for values, x in zip(lists, (_key(" ".join(map(str, outer))), _key("\0".join(t for _, t in _slots(found))), list(counts), list(counts.values())), strict=True):
                values.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("host", "section", "page")] + [pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], ["host", "section", "page", "layout", "content", "tokens", "times"])


def _extracted(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _owned(host: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Hosts' tokens among all hosts' tokens."""
    return mix(numbers.astype(np.int64).view(np.uint64) ^ (host.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _by_broadcast(shared):
    def run(batches):
        keys, classes = shared.value
        for batch in chunked(batches, "html"):
            texts = []
            for host, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host_key", "html")), strict=True):

                def template(numbers, host=host):
                    own = _owned(np.array([host]), np.array(numbers, np.int64))
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    return np.where(keys[at] == own, classes[at], 0).tolist() if len(keys) else [0] * len(numbers)

                texts.append(main_text(page or "", template))
            yield _extracted(batch, texts)

    return run


def _by_join(batches):
    for batch in chunked(batches, "html"):
        texts = []
        for found, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("template", "html")), strict=True):
            known = {x["token"]: x["class"] for x in found or ()}
            texts.append(main_text(page or "", lambda numbers, known=known: [known.get(n, 0) for n in numbers]))
        yield _extracted(batch, texts)


def _hosted(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    section = F.xxhash64(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1))
    html = F.col("html").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.xxhash64(host).alias("host_key"), section.alias("section"), F.xxhash64(html, F.reverse(html)).alias("page"), html.alias("html"))


def templates(parsed: DataFrame) -> DataFrame:
    """host, token, class (a number that is not 0) and pages: the tokens of the hosts' valid equivalence classes."""
    # Copies of a content count once, by the page of the lowest number.
    once = parsed.groupBy("host", "content").agg(F.min_by(F.struct("section", "layout", "tokens", "times"), F.col("page")).alias("p")).select("host", "content", "p.*")
    once = written(once, "contents")
    tokens = once.select("host", "section", "layout", "content", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("host", "section", "layout", "content", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))
    mark = F.xxhash64("content", "times")
    least = lambda c: (F.min(c).alias(c), F.max(c).alias(f"{c}_to"))
    seen = written(tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(mark).alias("vector"), *least("section"), *least("layout")).where("pages > 1"), "tokens")
    kinds = ["host", "pages", "vector", "section", "section_to", "layout", "layout_to"]
    valid = seen.groupBy(*kinds).agg(F.count("*").alias("tokens")).where(F.col("tokens") >= CLASS_TOKENS)
    # A class is judged against the smallest group of like pages that holds all of its pages.
    groups = once.groupBy("host", "section", "layout").agg(F.count("*").alias("n"))
    valid = valid.join(groups.groupBy("host").agg(F.sum("n").alias("like_host")), "host")
    for c in ("section", "layout"):
        like = groups.groupBy(F.col("host").alias("_host"), F.col(c).alias("_of")).agg(F.sum("n").alias(f"like_{c}"))
        valid = valid.withColumn("_in", F.when((F.col(c) == F.col(f"{c}_to")) & (F.col("pages") >= GROUP_PAGES), F.col(c)))
        valid = valid.join(like, (F.col("host") == F.col("_host")) & (F.col("_in") == F.col("_of")), "left").drop("_host", "_of", "_in")
    valid = valid.where(F.col("pages") >= CLASS_SHARE * F.least("like_host", "like_section", "like_layout")).select(*kinds)
    name = F.xxhash64(*kinds)
    return seen.join(valid, kinds).select("host", "token", F.when(name == 0, 1).otherwise(name).alias("class"), "pages")


def extract(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    hosted, out = _hosted(pages), "page_id long, url string, text string, n_chars long"
    parsed = written(hosted.select("host", "section", "page", "html").mapInArrow(_parsed, "host string, section long, page long, layout long, content long, tokens array<long>, times array<int>"), "pages")
    template = written(templates(parsed), "template")
    if template.count() <= broadcast_tokens:
        rows = template.select(F.xxhash64("host").alias("host"), "token", "class").toArrow()
        host, token, kind = (rows.column(k).to_numpy() for k in range(3))
        keys = _owned(host, token)
        order = np.argsort(keys)
        shared = pages.sparkSession.sparkContext.broadcast((keys[order], kind[order]))
        return hosted.select("page_id", "url", "host_key", "html").mapInArrow(_by_broadcast(shared), out)
    # Of each page the template tokens that it holds; a token of many pages is dealt out.
    held = parsed.select("host", "page", F.explode("tokens").alias("token")).distinct()
    sizes = template.select("host", "token", F.col("pages").alias("n"))
    held = dealt_join(held, template.select("host", "token", "class"), ["host", "token"], sizes, "page").groupBy("host", "page").agg(F.collect_list(F.struct("token", "class")).alias("template"))
    sizes = parsed.groupBy("host", "page").agg(F.count("*").alias("n"))
    return dealt_join(hosted.select("page_id", "url", "host", "page", "html"), held, ["host", "page"], sizes, "page_id", "left").select("page_id", "url", "html", "template").mapInArrow(_by_join, out)
