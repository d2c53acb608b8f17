"""Search over a relation of documents: scan, collapse, filter, facets, groups, order and pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import text as T
from quern.plans import compile as C
from quern.plans.language import Prepared

#: Media types that are collapsed to one result for each story.
STORIES = ("article", "pdf", "broadcast")


def scored(docs: DataFrame, q: Prepared) -> DataFrame:
    """Documents that reach the least score, with baseScore and the boosted score; nothing is filtered by structure yet."""
    fields = C.needed(q)
    out = C.with_fields(docs, fields).withColumn("baseScore", C.base_score(q).cast("int")).where(F.col("baseScore") >= C.MINIMUM)
    out = out.withColumn("score", C.boosted(F.col("baseScore"), q.filters.tab).cast("int"))
    return out.drop(*fields)


def unscored(docs: DataFrame) -> DataFrame:
    """For queries of filters only: every document with score 0."""
    return docs.withColumns({"baseScore": F.lit(0), "score": F.lit(0)})


def order(q: Prepared, by_text: bool = True) -> list[Column]:
    """Total orders, ties broken by id."""
    rank, shown = C.priority(), F.col("displayOrder")
    if q.filters.sort == "latest":
        return [F.desc("date"), rank, F.desc("score"), shown, F.col("title"), F.col("id")]
    if not by_text:
        return [rank, F.desc("date"), shown, F.col("title"), F.col("id")]
    return [F.desc("score"), rank, shown, F.desc("date"), F.col("id")]


def story_key(composed: bool = True) -> Column:
    """Source, media type, day and comparable title."""
    title = T.story_text_plain(F.col("title")) if composed else T.story_text(F.col("title"))
    return F.concat_ws("\n", T.first_filled(F.col("displaySourceId"), F.col("sourceId")), F.col("mediaType"), F.col("date"), title)


def collapsed(docs: DataFrame, ordering: list[Column], composed: bool = True) -> DataFrame:
    """The first of each story in the given order; other media stay.  Comes before structured filters: a hidden copy stays hidden."""
    keyed = docs.withColumn("_key", F.when(F.col("mediaType").isin(*STORIES), story_key(composed)).otherwise(F.concat(F.lit("id\n"), F.col("id").cast("string"))))
    return keyed.withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy(*ordering))).where("_first = 1").drop("_key", "_first")


def facets(docs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Counts by source; with sources, names and catalogue order (unknown ones last, under their id), the largest first,
    then by catalogue order and name."""
    out = docs.groupBy("sourceId").agg(F.count("*").alias("n"))
    if sources is None:
        return out
    known = sources.select(F.col("id").alias("sourceId"), "name", "place")
    size = F.lit(None).cast("int")
    return out.join(known, "sourceId", "left").select("sourceId", F.coalesce("name", "sourceId").alias("name"), F.coalesce("place", size).alias("place"), "n").orderBy(F.desc("n"), F.col("place").asc_nulls_last(), "name", "sourceId")


def merge_facets(*parts: DataFrame) -> DataFrame:
    """Partial counts to final ones."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("sourceId").agg(F.sum("n").alias("n"))


def page(docs: DataFrame, q: Prepared, by_text: bool = True) -> DataFrame:
    """One page in total order: Spark keeps the top offset + limit rows of each task only."""
    return docs.orderBy(*order(q, by_text)).offset(q.filters.offset).limit(q.filters.limit)


def clamped(q: Prepared, total: int) -> Prepared:
    """The query at the last page that has rows, where its offset lies beyond all of them."""
    size = max(1, q.filters.limit)
    last = max(0, (total - 1) // size) * size
    return replace(q, filters=replace(q.filters, offset=max(0, min(q.filters.offset, last))))


def promoted(docs: DataFrame, source: str) -> DataFrame:
    """Documents of an exactly named source gain a little and come first; their own score stays beside it."""
    own = F.col("sourceId") == source
    out = docs.withColumns({"backendScore": F.when(own, F.col("score")), "score": F.when(own, F.col("score") + C.PROMOTION).otherwise(F.col("score"))})
    return out.withColumn("promoted", own).orderBy(F.desc("promoted"), F.desc("score"), "id")


def groups(results: DataFrame, latest: bool = False) -> DataFrame:
    """A page's results by source: size, best score (0 at least), latest day, members in order."""
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id"))), lambda m: m["id"])
    out = results.groupBy("sourceId").agg(F.count("*").alias("n"), F.greatest(F.max("score"), F.lit(0)).alias("best"), F.max("date").alias("latest"), members.alias("ids"))
    return out.orderBy(*([F.desc("latest")] if latest else []), F.desc("best"), "sourceId")


def search(docs: DataFrame, q: Prepared) -> DataFrame:
    """The whole read path but paging: scan, collapse, filters."""
    by_text = bool(q.branches)
    found = scored(docs, q) if by_text else unscored(docs)
    return collapsed(found, order(q, by_text)).where(C.predicate(q.filters, columns=tuple(docs.columns)))


def excerpt(snippet: Column, term: str, size: int = 190) -> Column:
    """A stretch of a snippet around the first hit."""
    at = F.instr(F.lower(snippet), term.lower())
    begin = F.greatest(F.lit(1), at - size // 3)
    return F.when(at > 0, snippet.substr(begin, F.lit(size))).otherwise(F.left(snippet, F.lit(size)))


def highlight(text: Column, term: str, most: int = 4) -> Column:
    """Ranges (start, end) of a term's first hits, not overlapping, from 0."""
    low, size = F.lower(text), len(term)
    pieces = F.split(low, "\\Q" + term.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * size)
    return F.when(F.size(pieces) > 1, F.slice(F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + size).cast("int").alias("end"))), 1, most)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def merged_ranges(ranges: Column) -> Column:
    """Ranges by start, the longer first, without those that overlap an earlier one."""
    kind = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("e"), r["end"].alias("end"))))
    return F.aggregate(ordered, F.array().cast(kind), lambda acc, r: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) > r["start"]), acc).otherwise(F.concat(acc, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"))))))


def suggestions(entries: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Labels for what is typed: the same, begun by it, begun without spaces, or containing it; aliases a little lower; first come first."""
    want, tight = typed.strip().lower(), "".join(typed.lower().split())
    label = F.lower("label")
    squeezed = F.regexp_replace(label, "\\s+", "")
    score = F.when(label == want, 120).when(label.startswith(want), 105).when(squeezed.startswith(tight), 104).when(squeezed.contains(tight), 92).otherwise(0) - F.when(F.col("alias"), 8).otherwise(0)
    return entries.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "place", "label").limit(limit)


def dictionary(*parts: DataFrame) -> DataFrame:
    """One table of suggestion labels; of a label's entries the one of the earliest part and place stays."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("label", "alias", F.lit(k).alias("part"), "place")
        out = p if out is None else out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("label").orderBy("part", "place"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n")
