"""Search providers: one interface, a local implementation, and fail-over; `python -m quern.provider --documents FILE QUERY` searches files."""

from __future__ import annotations

import argparse
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import schema
from quern.operators import search as S
from quern.plans.language import Filters, prepare
from quern.sources import readers


class Provider(Protocol):
    def search(self, query: str, filters: Filters = Filters()) -> DataFrame: ...

    def suggest(self, typed: str) -> DataFrame: ...

    def document(self, ident: str) -> DataFrame: ...


class LocalProvider:
    """Over a relation of documents and a small table of sources."""

    def __init__(self, documents: DataFrame, sources: list[dict] | None = None):
        self.documents, self.sources = documents, sources or []

    def search(self, query: str, filters: Filters = Filters()) -> DataFrame:
        plan = prepare(query, self.sources, filters)
        return S.page(S.search(self.documents, plan), plan, bool(plan.branches))

    def facets(self, query: str, filters: Filters = Filters()) -> DataFrame:
        return S.facets(S.search(self.documents, prepare(query, self.sources, filters)))

    def suggest(self, typed: str) -> DataFrame:
        titles = self.documents.where("title <> ''").select(F.col("title").alias("label"), F.lit(False).alias("alias"), F.xxhash64("id").alias("place"))
        return S.suggestions(S.dictionary(titles), typed)

    def document(self, ident: str) -> DataFrame:
        return self.documents.where(F.col("id") == ident).limit(1)


class FallbackProvider:
    """The first provider that does not raise; of a search, rows of the second fill up where the first has fewer than `least`."""

    def __init__(self, first: Provider, second: Provider, least: int = 12):
        self.first, self.second, self.least = first, second, least

    def search(self, query: str, filters: Filters = Filters()) -> DataFrame:
        try:
            found = self.first.search(query, filters)
            few = found.limit(self.least).count() < self.least
        except Exception:  # noqa: BLE001  any failure of the first is what the second is for
            return self.second.search(query, filters)
        if not few or filters.offset:
            return found
        more = self.second.search(query, filters).join(found.select("id"), "id", "left_anti")
        return found.unionByName(more, allowMissingColumns=True)

    def suggest(self, typed: str) -> DataFrame:
        try:
            return self.first.suggest(typed)
        except Exception:  # noqa: BLE001
            return self.second.suggest(typed)

    def document(self, ident: str) -> DataFrame:
        try:
            found = self.first.document(ident)
            return self.second.document(ident) if found.isEmpty() else found
        except Exception:  # noqa: BLE001
            return self.second.document(ident)


def main() -> None:
    p = argparse.ArgumentParser(description="Search documents in JSON or JSON Lines files.")
    p.add_argument("query")
    p.add_argument("--documents", action="append", default=[])
    p.add_argument("--limit", type=int, default=10)
    a = p.parse_args()
    spark = SparkSession.builder.appName("search").getOrCreate()
    docs = schema.normalized(readers.documents(spark, a.documents))
    LocalProvider(docs).search(a.query, Filters(limit=a.limit)).select("score", "date", "title", "url").show(a.limit, truncate=80)


if __name__ == "__main__":
    main()
