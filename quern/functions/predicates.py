"""Named predicates over URLs, paths and page texts, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from quern.functions import urls

# What blocked pages say, files of page furniture, extensions of assets.
BLOCKED = ("access denied", "checking your browser", "enable javascript and cookies", "403 forbidden")
DECORATIVE = ("back", "prev", "next", "spacer", "blank", "loading", "loader")
IMAGES, DOCUMENTS, VIDEOS = ("png", "jpg", "jpeg", "webp", "gif"), ("pdf",), ("mp4", "webm", "mov", "m4v")
GENERIC_TITLES = ("untitled", "home", "index", "404", "not found")
CHROME_LINES = ("home", "menu", "search", "share", "print", "login", "top")


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def _path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def _named(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(extensions) + ")$")


def matches_any(url: Column, patterns: list[str]) -> Column:
    """A pattern between slashes is a regular expression, any other a part of the URL."""
    return _any([url.rlike(p[1:-1]) if len(p) > 2 and p[0] == p[-1] == "/" else url.contains(p) for p in patterns])


def crawlable(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Some include pattern matches, if there are any, and no exclude pattern."""
    return (matches_any(url, list(include)) if include else F.lit(True)) & ~matches_any(url, list(exclude))


def allowed_host(url: Column, base: Column) -> Column:
    """The URL's host is that of the base URL or lies below it; false where either has none."""
    own, of = urls.host(url), urls.host(base)
    return (own != "") & (of != "") & urls.under(own, of)


def official(url: Column, hosts: list[str]) -> Column:
    """A web address at one of the hosts or below it, without user name."""
    own = urls.host(url)
    return url.rlike("(?i)^https?://[^/@]+(?:[/?#]|$)") & _any([urls.under(own, F.lit(h)) for h in hosts])


def blocked(html: Column) -> Column:
    """An empty page, or one that only says that it is kept back."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return (F.trim(low) == "") | _any([low.contains(x) for x in BLOCKED])


def readable(text: Column) -> Column:
    """A page in the readable form: title, source URL and Markdown content."""
    return text.rlike(r"(?m)^Title:\s+") & text.rlike(r"(?m)^URL Source:\s+") & text.contains("Markdown Content:")


def generic_title(title: Column) -> Column:
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", *GENERIC_TITLES)


def chrome_line(line: Column) -> Column:
    """A line that is navigation, not text."""
    return F.lower(F.regexp_replace(F.trim(line), "[\\p{P}\\p{S}\\s]+", "")).isin("", *CHROME_LINES)


def classified(categories: Column) -> Column:
    return F.coalesce(F.size(categories), F.lit(0)) > 0


def cacheable(url: Column, media: Column | None = None) -> Column:
    """An asset of the web by its extension; with a media type, an image or a document of that type."""
    path, remote = _path(url), url.rlike("(?i)^https?://")
    if media is None:
        return remote & _named(path, IMAGES + DOCUMENTS + VIDEOS)
    return remote & F.when(media == "image", _named(path, IMAGES)).when(media == "pdf", _named(path, DOCUMENTS)).otherwise(False)


def decorative(url: Column) -> Column:
    """An image that is a button or a place holder, by its file name."""
    return F.lower(F.regexp_extract(_path(url), "[^/]*$", 0)).rlike("^(?:" + "|".join(DECORATIVE) + ")(?:[-_](?:btn|button|icon))?\\.(?:" + "|".join(IMAGES) + ")$")


def ignored(path: Column, rules: list[str]) -> Column:
    """A path that an ignore rule names: `dir/` is a folder (anywhere, unless it begins with or holds a slash), `*` any characters."""
    parts = []
    for rule in (r.replace("\\", "/") for r in rules):
        name = rule.strip("/")
        if not name:
            continue
        form = ".*".join(re.escape(x) for x in name.split("*"))
        if rule.endswith("/"):
            parts.append(path.startswith(f"{name}/") if rule.startswith("/") or "/" in name else F.concat(F.lit("/"), path).contains(f"/{name}/"))
        else:
            target = path if "/" in name else F.regexp_extract(path, "[^/]*$", 0)
            parts.append(target.rlike(f"^(?:{form})$"))
    return _any(parts)


def references(json: Column, prefix: str) -> Column:
    """All distinct strings anywhere in a JSON text, at any depth, that begin with a prefix; in order."""
    value = '"(' + re.escape(prefix) + r'(?:[^"\\]|\\.)*)"(?!\s*:)'
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json, F.lit(value), F.lit(1))))
