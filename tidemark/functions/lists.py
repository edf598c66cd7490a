"""List columns: padding, capping, merging. All order-preserving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal_strings(values: Sequence[str]) -> Column:
    return F.lit(list(values)) if values else F.array().cast("array<string>")


def cap(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def pad_by_index(c: Column, defaults: Sequence[str]) -> Column:
    """Fill up to ``len(defaults)`` items, taking the default of each missing position."""
    have = F.coalesce(c, F.array().cast("array<string>"))
    missing = F.greatest(F.lit(0), F.lit(len(defaults)) - F.size(have))
    return F.concat(have, F.slice(literal_strings(defaults), F.size(have) + 1, missing))


def pad_with_absent(c: Column, defaults: Column, minimum: int) -> Column:
    """Append defaults not in the list, in order, until it holds ``minimum`` items."""
    missing = F.greatest(F.lit(0), F.lit(minimum) - F.size(c))
    return F.concat(c, F.slice(F.array_except(defaults, c), F.lit(1), missing))


def merge_distinct(*lists: Column) -> Column:
    """First occurrences of the concatenated lists."""
    return F.array_distinct(F.concat(*lists))


def non_empty_or(c: Column, defaults: Sequence[str]) -> Column:
    return F.when(F.size(c) > 0, c).otherwise(literal_strings(defaults))
