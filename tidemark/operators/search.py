"""Faceted free-text search over the compact index, and point lookup.

A page is a top-k: ``orderBy`` + ``offset`` + ``limit`` never sorts the whole result.
For deep pages pass ``after``, the sort key of the last row seen, instead of a page.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab

FACETS = {"category": "c", "difficulty": "d", "framework": "fw", "language": "lang", "audience": "a"}
SORTS = ("relevance", "quality", "az")


@dataclass(frozen=True)
class Query:
    """Search request. ``filters`` maps facet names to the wanted value or None."""

    text: str = ""
    filters: Mapping[str, str | None] = field(default_factory=dict)
    sort: str = "relevance"

    def toggle(self, facet: str, value: str) -> Query:
        """Choosing the active value again clears it."""
        chosen = None if self.filters.get(facet) == value else value
        return replace(self, filters={**self.filters, facet: chosen})

    def cleared(self) -> Query:
        return replace(self, text="", filters={})

    @property
    def active(self) -> int:
        return sum(1 for v in self.filters.values() if v)


def matching(
    index: DataFrame, query: Query, facets: Mapping[str, str] = FACETS, haystack: str = "haystack"
) -> DataFrame:
    """Rows that satisfy all active facets and contain the text. Facets push down."""
    tests: list[Column] = [F.col(facets[f]) == v for f, v in query.filters.items() if v]
    wanted = query.text.strip().lower()
    if wanted:
        tests.append(F.contains(F.col(haystack), F.lit(wanted)))
    return index.filter(reduce(Column.__and__, tests)) if tests else index


def _order(sort: str, score: str, title: str, pos: str) -> list[Column]:
    if sort == "quality":
        return [F.coalesce(F.col(score), F.lit(0)).desc(), F.col(pos)]
    if sort == "az":
        return [F.collate(F.col(title), "UNICODE"), F.col(pos)]
    if sort == "relevance":
        return [F.col(pos)]
    raise ValueError(f"unknown sort {sort!r}, use one of {SORTS}")


def page(
    rows: DataFrame,
    sort: str = "relevance",
    number: int = 0,
    size: int = vocab.PAGE_SIZE,
    after: tuple | None = None,
    score: str = "q",
    title: str = "t",
    pos: str = "pos",
) -> DataFrame:
    """One page in sort order. ``after`` = (pos,), (score, pos) or (title, pos)."""
    if after is not None:
        rows = rows.filter(_beyond(sort, after, score, title, pos))
        number = 0
    return rows.orderBy(*_order(sort, score, title, pos)).offset(number * size).limit(size)


def _beyond(sort: str, after: tuple, score: str, title: str, pos: str) -> Column:
    later = F.col(pos) > after[-1]
    if sort == "quality":
        value = F.coalesce(F.col(score), F.lit(0))
        return (value < (after[0] or 0)) | ((value == (after[0] or 0)) & later)
    if sort == "az":
        mine, last = F.collate(F.col(title), "UNICODE"), F.collate(F.lit(after[0]), "UNICODE")
        return (mine > last) | ((mine == last) & later)
    return later


def search(index: DataFrame, query: Query, number: int = 0, size: int = vocab.PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(page, one-row count) of a query."""
    found = matching(index, query)
    return page(found, query.sort, number, size), found.agg(F.count(F.lit(1)).alias("n"))


def find_record(index: DataFrame, records: DataFrame, id: str) -> DataFrame:
    """Full record of an id: the index tells the category, which prunes the record scan.

    When an id repeats, the first one in input order is meant. The index side is one
    row, so broadcasting it is safe and lets Spark prune partitions at run time.
    """
    hit = (
        index.filter(F.col("id") == id)
        .agg(F.min(F.struct("pos", F.col("c").alias("category"))).alias("h"))
        .select("h.*")
    )
    return records.filter(F.col("id") == id).join(F.broadcast(hit), ["category", "pos"])
