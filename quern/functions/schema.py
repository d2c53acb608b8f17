"""Fixed schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from quern.functions.text import first_filled

_S = StringType()


def _struct(text: tuple[str, ...], **more) -> StructType:
    return StructType([StructField(n, _S) for n in text] + [StructField(n, t) for n, t in more.items()])


DOCUMENT = _struct(
    ("id", "title", "snippet", "body", "date", "sourceId", "sourceName", "sourceType", "displaySourceId", "displaySourceName", "displaySourceType", "mediaType", "url", "archiveUrl", "originalSourceUrl", "thumbnailUrl", "cachedUrl", "cachedThumbnailUrl", "language", "searchSnippet", "searchBody", "previewText", "previewSourceName", "previewDocumentId"),
    aliases=ArrayType(_S), searchTabs=ArrayType(_S), displayOrder=DoubleType(),
)
CRAWLER = StructType([StructField("enabled", BooleanType()), *(StructField(n, _S) for n in ("entryUrl", "strategy", "schedule", "robotsPolicy", "notes")), StructField("selectors", MapType(_S, _S))])
SOURCE = _struct(("id", "name", "sourceType", "baseUrl"), languages=ArrayType(_S), mediaTypes=ArrayType(_S), aliases=ArrayType(_S), crawler=CRAWLER)
NEWS = _struct(
    ("id", "sourceId", "sourceName", "language", "mediaType", "title", "snippet", "body", "date", "url", "articleUrl", "articleId", "thumbnailUrl", "cachedUrl", "cachedThumbnailUrl"),
    schemaVersion=IntegerType(), displayOrder=IntegerType(), categories=ArrayType(_S), categoryOrders=MapType(_S, LongType()),
)
VIDEO = _struct(("id", "videoId", "title", "channelName", "publishedAt", "date", "url", "thumbnailUrl"))
LISTING = _struct(("sourceId", "title", "date", "url", "kind", "previewImageUrl"), category=_struct(("id", "label")), categories=ArrayType(_S), categoryOrders=MapType(_S, IntegerType()), markers=StructType([StructField("camera", BooleanType()), StructField("gallery", BooleanType())]))

# Defaults and enumerations of documents.
DEFAULTS = {"sourceType": "archive", "mediaType": "article", "language": "ko"}
MEDIA_TYPES = ("article", "pdf", "image", "video", "broadcast")


def normalized(docs: DataFrame) -> DataFrame:
    """Every declared column, missing ones as defaults; display source columns default to the source's own."""
    have = set(docs.columns)
    get = lambda n: F.col(n) if n in have else F.lit(None).cast(DOCUMENT[n].dataType)
    out = {}
    for f in DOCUMENT:
        if f.dataType == _S:
            own = f.name.replace("displaySource", "source") if f.name.startswith("displaySource") else None
            out[f.name] = first_filled(get(f.name).cast("string"), *([get(own).cast("string")] if own else []), F.lit(DEFAULTS.get(own or f.name, "")))
        else:
            out[f.name] = F.coalesce(get(f.name), F.array().cast(f.dataType)) if isinstance(f.dataType, ArrayType) else get(f.name)
    return docs.select(*(c.alias(n) for n, c in out.items()))


def stored(docs: DataFrame) -> DataFrame:
    """Only the declared columns: derived ones are not stored."""
    return docs.select(*(n for n in DOCUMENT.fieldNames() if n in docs.columns))
