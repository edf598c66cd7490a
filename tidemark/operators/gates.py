"""Pass/fail decisions from one-row aggregates; thresholds are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab


def dataset_gate(
    category_counts: DataFrame,
    surplus: DataFrame,
    openings: DataFrame,
    min_total: int = vocab.MIN_TOTAL,
    min_categories: int = vocab.MIN_CATEGORIES,
    min_per_category: int = vocab.MIN_PER_CATEGORY,
    gating_keys: tuple[str, ...] = ("id", "slug"),
) -> DataFrame:
    """Totals, each gate and the overall result in one row.

    ``category_counts`` is (key, n), ``surplus`` as from ``dups.surplus``, ``openings``
    the overused openings. Duplicate titles are counted but do not gate.
    """
    totals = category_counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("categories"),
        F.coalesce(F.min("n"), F.lit(0)).alias("smallest_category"),
    )
    gating = surplus.filter(F.col("kind").isin(*gating_keys)).agg(
        F.coalesce(F.sum("n_surplus"), F.lit(0))
    )
    row = totals.select(
        "*",
        gating.scalar().alias("duplicate_keys"),
        openings.agg(F.count(F.lit(1))).scalar().alias("overused_openings"),
    )
    gates = {
        "total_ok": F.col("total") >= min_total,
        "categories_ok": F.col("categories") >= min_categories,
        "keys_ok": F.col("duplicate_keys") == 0,
        "openings_ok": F.col("overused_openings") == 0,
        "per_category_ok": F.col("smallest_category") >= min_per_category,
    }
    passed = reduce(Column.__and__, gates.values())
    return row.withColumns(gates).withColumn(
        "result", F.when(passed, "PASS").otherwise("FAIL")
    )


def duplicate_status(sections: dict[str, DataFrame]) -> DataFrame:
    """One row: number of findings per section, overall status and key status.

    ``CLEAN`` needs all sections empty; ``PASS`` only fingerprint, title and slug.
    """
    first, *rest = sections
    row = sections[first].agg(F.count(F.lit(1)).alias(first))
    row = row.select(
        first, *[sections[s].agg(F.count(F.lit(1))).scalar().alias(s) for s in rest]
    )

    def empty(names) -> Column:
        return reduce(Column.__and__, [F.col(n) == 0 for n in names])

    keys = [s for s in sections if s in ("fingerprint", "title", "slug")]
    return row.select(
        "*",
        F.when(empty(sections), "CLEAN").otherwise("NEEDS_REVIEW").alias("overall_status"),
        F.when(empty(keys), "PASS").otherwise("NEEDS_REVIEW").alias("key_status"),
    )
