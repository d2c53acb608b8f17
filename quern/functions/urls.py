"""URLs, hashes and tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(url: Column) -> Column:
    """The canonical host: lower-case, without www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")


def under(h: Column, suffix: Column) -> Column:
    """Equal to or below a host."""
    return (h == suffix) | h.endswith(F.concat(F.lit("."), suffix))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without www, no fragment, no campaign parameters, no trailing slash."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, "([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, "&&+", "&"), "\\?&", "?")
    head, rest = F.lower(F.regexp_extract(u, "^([A-Za-z]+://[^/?]*)(.*)$", 1)), F.regexp_extract(u, "^([A-Za-z]+://[^/?]*)(.*)$", 2)
    return F.regexp_replace(F.concat(F.regexp_replace(head, "://www\\.", "://"), rest), "[?&/]+$", "")


def fnv1a(c: Column) -> Column:
    """FNV-1a over the code points of a text below 256, 32 bits."""
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("long"), lambda h, ch: F.when(ch == "", h).otherwise(h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long")))


def shard(c: Column) -> Column:
    """One of 256 shards in two hexadecimal digits: the low byte of fnv1a."""
    return F.lower(F.lpad(F.hex(F.pmod(fnv1a(c), F.lit(256))), 2, "0"))


def crawl_id(c: Column) -> Column:
    return F.left(F.sha1(c.cast("binary")), F.lit(16))


def news_id(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(24))


def pair_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws("\n", a, b).cast("binary"), 256)


def base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def video_id(url: Column) -> Column:
    return F.regexp_extract(url, "(?:v=|youtu\\.be/|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)


def safe_asset(path: Column) -> Column:
    return path.rlike("^[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$") & ~path.contains("..")


def image_format(data: Column) -> Column:
    """By magic bytes of a binary column."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("FFD8FF"), "jpg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("474946383"), "gif").when(h.rlike("^52494646.{8}57454250"), "webp")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC from the built-in hash: two rounds over the padded key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256)
