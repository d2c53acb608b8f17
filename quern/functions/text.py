"""Text normalisation as Column expressions (JVM-side, no Python functions)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space as the search language knows it: Java's \\s lacks the wider spaces and U+FEFF.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space to their plain forms."""
    return F.translate(c, _WIDE, _PLAIN)


#: The characters of SPACE, one by one.
_SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def compact(c: Column) -> Column:
    """Plain width, without white space: characters beyond the second list are left out."""
    return F.translate(c, _WIDE[:-1] + _SPACES, _PLAIN[:-1])


def unmarked(c: Column) -> Column:
    """Without punctuation and symbols."""
    return F.regexp_replace(c, "[\\p{P}\\p{S}]+", "")


def simplified(c: Column) -> Column:
    """Compact, without punctuation and symbols."""
    return unmarked(compact(c))


def token(c: Column) -> Column:
    """The comparable forms of a text: struct(lower, compactLower)."""
    return F.struct(F.lower(simplified(c)).alias("lower"), F.lower(compact(c)).alias("compactLower"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, SPACE + "+", " "))


def first_filled(*columns: Column) -> Column:
    """The first non-empty string, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def jamo(c: Column) -> Column:
    """Hangul syllables as compatibility jamo; other characters unchanged.  A syllable's number gives its lead, vowel and tail."""
    # Compatibility jamo in the order of leads, vowels and tails (the first tail is none).
    lead = F.array(*(F.lit(x) for x in "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"))
    vowel = F.array(*(F.lit(x) for x in "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"))
    tail = F.array(F.lit(""), *(F.lit(x) for x in "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"))

    def one(ch: Column) -> Column:
        n = F.ascii(ch) - 0xAC00
        parts = F.concat(F.get(lead, (n / 588).cast("int")), F.get(vowel, (F.pmod(n, F.lit(588)) / 28).cast("int")), F.get(tail, F.pmod(n, F.lit(28)).cast("int")))
        return F.when((n >= 0) & (n < 11172), parts).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def ngrams(c: Column, sizes: tuple[int, ...] = (2, 3, 4), limit: int = 240) -> Column:
    """Character n-grams of each size, in order, the first `limit` of all.  A text long enough to be cut here has `limit`
    n-grams of the first size in the part that is kept; it is a lambda's variable, since n-grams would each compute it again."""

    def of(s: Column, size: int) -> Column:
        last = F.length(s) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: s.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    kept = F.left(c, F.lit(limit + max(sizes) - 1))
    return F.get(F.transform(F.array(kept), lambda s: F.slice(F.concat(*(of(s, n) for n in sizes)), 1, limit)), F.lit(0))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


DATELINE = "\\([^()\\n]{1,24}(?:\\d{1,2}월\\s?\\d{1,2}일|(?:January|February|March|April|May|June|July|August|September|October|November|December) \\d{1,2})[^()\\n]{0,24}\\)"


def without_dateline(c: Column) -> Column:
    """Without wire datelines in brackets; white space is squeezed only where one was found."""
    return F.when(c.rlike(DATELINE), squeezed(F.regexp_replace(c, DATELINE, " "))).otherwise(c)


def focused(c: Column, limit: int = 1400) -> Column:
    """The part of a body that is searched: its first `limit` characters (of a slightly longer cut) without datelines."""
    return F.left(without_dateline(F.left(c, F.lit(int(limit * 1.25)))), F.lit(limit))


def markdown_plain(c: Column) -> Column:
    """Without Markdown marks: images, links' targets, headings, emphasis and list marks."""
    for pattern, new in (("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("(?m)^#{1,6}\\s+", ""), ("[*_`]{1,3}", ""), ("(?m)^\\s*[-+]\\s+", "")):
        c = F.regexp_replace(c, pattern, new)
    return squeezed(c)


def decorated_aliases(c: Column) -> Column:
    """Titles in quotes or brackets inside a title."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("[\"'(\\[《〈「『]([^\"'()\\[\\]《》〈〉「」『』]{2,})[\"')\\]》〉」』]"), F.lit(1)), lambda x: x != ""))


def split_aliases(c: Column) -> Column:
    """Parts of a title divided by a slash or a spaced dash."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "\\s*/\\s*|\\s+-\\s+"), trimmed), lambda x: x != ""))


def repeated(a: Column, b: Column, least: int = 20) -> Column:
    """Whether one comparable text begins with the other, of 20 characters at least."""
    x, y = F.lower(simplified(a)), F.lower(simplified(b))
    return (F.least(F.length(x), F.length(y)) >= least) & (x.startswith(y) | y.startswith(x))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\\n+"), squeezed), lambda x: x != "")


def longest(old: Column, new: Column) -> Column:
    """The longer text; the new one where they tie."""
    return F.when(F.length(F.coalesce(new, F.lit(""))) >= F.length(F.coalesce(old, F.lit(""))), new).otherwise(old)


def language(url: Column, text: Column) -> Column:
    """By the URL's language segment, else by scripts; several scripts give 'multi'."""
    segment = F.lower(F.regexp_extract(url, "^[a-z]+://[^/]+/(ko|en|ja|zh|ru|es|fr|de|ar)(?:[/?#]|$)", 1))
    scripts = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(code)) for p, code in (("[가-힣]", "ko"), ("[ぁ-ヿ]", "ja"), ("[А-я]", "ru"), ("[؀-ۿ]", "ar"), ("[A-Za-z]{3}", "en")))))
    return F.when(segment != "", segment).when(F.size(scripts) > 1, F.lit("multi")).otherwise(F.coalesce(F.get(scripts, F.lit(0)), F.lit("ko")))


def media_type(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return F.when(path.rlike("\\.pdf$"), "pdf").when(path.rlike("\\.(jpe?g|png|gif|webp)$"), "image").when(path.rlike("\\.(mp4|m3u8|webm)$|/video/|youtu"), "video").otherwise("article")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition: there is no built-in function for it."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def story_text(c: Column) -> Column:
    """A title's comparable key: lower-case letters and digits of its compatibility composition."""
    return F.regexp_replace(F.lower(nfkc(c)), "[^\\p{L}\\p{N}]+", "")


def story_text_plain(c: Column) -> Column:
    """The same for texts that are composed already; built-in functions only."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
