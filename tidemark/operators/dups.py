"""Exact duplicates: groups by key, their members, first occurrences, surplus counts.

Groups are counted with map-side combine before anything moves; member lists stay
in long form because one group may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import text
from ..spec import RecordSpec
from .ordering import HOT_ROWS, join_per_key


def keyed(df: DataFrame, key: Column, pos: str, id: str, *carry: str) -> DataFrame:
    """Narrow rows (key, pos, id, ...). A missing key groups as the empty string."""
    return df.select(
        F.coalesce(key, F.lit("")).alias("key"),
        F.col(pos).alias("pos"),
        F.col(id).alias("id"),
        *carry,
    )


def key_columns(spec: RecordSpec) -> dict[str, Column]:
    """The four duplicate keys of a record."""
    return {
        "fingerprint": text.fingerprint(F.coalesce(F.col(spec.text), F.lit(""))),
        "title": F.col(spec.title),
        "slug": F.col(spec.slug),
        # A sentence may be as long as its text, so its digest is the key.
        "first_sentence": F.sha2(text.first_sentence(F.coalesce(F.col(spec.text), F.lit(""))), 256),
    }


def groups(rows: DataFrame, minimum: int = 2) -> DataFrame:
    """(key, n, first_pos) of keys that occur at least ``minimum`` times."""
    return (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
        .filter(F.col("n") >= minimum)
    )


def members(rows: DataFrame, minimum: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of a duplicate group with the group's size and first position.

    ``rows`` is read twice; cut its lineage first when keys are costly to make.
    """
    return join_per_key(rows, groups(rows, minimum), "key", "pos", hot_rows=hot_rows)


def group_heads(rows: DataFrame, k: int, minimum: int = 2, carry: str | None = None) -> DataFrame:
    """Duplicate groups with their first ``k`` ids in input order, and ``carry`` of the first row.

    Only rows of duplicate groups are ordered. ``row_number() <= k`` is limited per task
    before the shuffle, so a hot group sends at most ``k`` rows from each task.
    """
    order = Window.partitionBy("key").orderBy("pos")
    more = [carry] if carry else []
    heads = (
        members(rows, minimum).select("key", "pos", "id", "n", "first_pos", *more)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .groupBy("key", "n", "first_pos")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("head"),
            *[F.min_by(c, "pos").alias(c) for c in more],
        )
    )
    return heads.select("key", "n", "first_pos", F.col("head.id").alias("ids"), *more)


def largest(found: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest groups; ties go to the key seen first."""
    return found.orderBy(F.col("n").desc(), "first_pos").limit(n)


def later_occurrences(rows: DataFrame) -> DataFrame:
    """Rows whose key was seen earlier, with the position of the first sighting."""
    return members(rows).filter(F.col("pos") > F.col("first_pos"))


def surplus(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Per key kind: rows, distinct keys and rows beyond the first of each key."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("kind"), F.coalesce(c.cast("string"), F.lit("")).alias("key"))
            for name, c in keys.items()
        ]
    )
    counted = (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.kind", "p.key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("kind").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("n") - 1).alias("n_surplus"),
    )


def overused_openings(
    df: DataFrame,
    text_col: str,
    n_words: int = vocab.OPENING_WORDS,
    max_uses: int = vocab.OPENING_MAX_USES,
) -> DataFrame:
    """Opening word sequences used more than ``max_uses`` times: (opening, uses)."""
    opening = text.first_words(F.coalesce(F.col(text_col), F.lit("")), n_words)
    return overused(df.select(opening.alias("opening")), "opening", max_uses)


def overused(df: DataFrame, opening: str, max_uses: int = vocab.OPENING_MAX_USES) -> DataFrame:
    return (
        df.groupBy(F.col(opening).alias("opening"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .filter(F.col("uses") > max_uses)
    )
