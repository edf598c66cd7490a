"""Exact ordered computations that never put a hot key into one task.

A plain ``row_number() over (partition by key order by pos)`` sends all rows of a
key to one task. Here the order column is cut into buckets of bounded size; counts
per (key, bucket) are summed with map-side combine, turned into offsets, and only
the rows of one (key, bucket) cell are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 200_000
CUTS = 4096
HOT_ROWS = 1_000_000
HOT_SALTS = 512


@dataclass(frozen=True)
class Buckets:
    """Maps an order column to a non-decreasing bucket number.

    Either every ``width`` values share a bucket, or ``bounds`` cut the column, and each
    stretch between two bounds is cut again into ``parts`` of equal width.
    """

    bounds: tuple[int, ...] = ()
    width: int | None = None
    parts: int = 1

    def of(self, pos: Column) -> Column:
        if self.width is not None:
            return F.call_function("div", pos, F.lit(self.width))
        if not self.bounds:
            return F.lit(0).cast("long")
        # Binary search over the literal bounds: number of bounds <= pos.
        n = len(self.bounds)
        steps, step = [], 1
        while step <= n:
            steps.insert(0, step)
            step *= 2
        bounds = F.lit(list(self.bounds))
        at = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, s: F.when(F.get(bounds, at + s - 1) <= pos, at + s).otherwise(at),
        )
        low, high = F.get(bounds, at - 1).cast("double"), F.get(bounds, at).cast("double")
        inside = F.floor((pos.cast("double") - low) / (high - low) * self.parts)
        part = F.coalesce(F.least(F.lit(self.parts - 1), inside), F.lit(0))
        return at.cast("long") * self.parts + part


def measure_buckets(df: DataFrame, pos: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Buckets:
    """Balanced buckets; what reaches the driver is a count and ``CUTS`` quantiles at most.

    Beyond ``CUTS`` buckets, the stretches between quantiles are cut further, so the number
    of buckets follows the number of rows at every size.
    """
    n = df.select(pos).count()
    wanted = -(-n // rows_per_bucket)
    cuts = max(1, min(CUTS, wanted))
    q = df.agg(
        F.percentile_approx(F.col(pos).cast("long"), F.lit([i / cuts for i in range(cuts + 1)]), F.lit(10 * CUTS))
    ).first()[0]
    parts = max(1, -(-wanted // cuts))
    # Only stretches that are cut again need to know the ends.
    inner = (q or []) if parts > 1 else (q or [])[1:-1]
    return Buckets(bounds=tuple(sorted(set(inner))), parts=parts)


def dense_buckets(rows_per_bucket: int = ROWS_PER_BUCKET) -> Buckets:
    """Buckets for an order column that has no gaps, such as a line number."""
    return Buckets(width=rows_per_bucket)


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    name: str,
    buckets: Buckets,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name``: the running sum of ``weight`` (default 1) per group, inclusive.

    Group columns must not be null; ``pos`` must be unique within a group, except
    that rows of weight 0 may share a position with others.
    """
    return running_sums(df, group, pos, {name: F.lit(1) if weight is None else weight}, buckets)


def running_sums(
    df: DataFrame, group: Sequence[str], pos: str, weights: dict[str, Column], buckets: Buckets
) -> DataFrame:
    """Like ``running_sum``, for several weights in the same shuffles: name -> weight."""
    weights = {name: weight.cast("long") for name, weight in weights.items()}
    upto_here = (Window.unboundedPreceding, Window.currentRow)
    cell = [*group, "_bucket"]
    cells = df.withColumn("_bucket", buckets.of(F.col(pos)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*cell)
        .agg(*[F.sum(w).alias(f"_sum_{name}") for name, w in weights.items()])
        .select(*cell, *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_offset_{name}") for name in weights])
    )
    inside = Window.partitionBy(*cell).orderBy(pos).rowsBetween(*upto_here)
    parts = [f"_{part}_{name}" for name in weights for part in ("inside", "offset")]
    return (
        cells.withColumns({f"_inside_{name}": F.sum(w).over(inside) for name, w in weights.items()})
        .join(offsets, cell)
        .withColumns({name: F.col(f"_inside_{name}") + F.col(f"_offset_{name}") for name in weights})
        .drop("_bucket", *parts)
    )


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    spread_by: str,
    count: str = "n",
    hot_rows: int = HOT_ROWS,
    salts: int = HOT_SALTS,
) -> DataFrame:
    """Inner join of rows with one row per key, salting only the hot keys.

    ``per_key`` carries the number of rows of its key in ``count``. Keys above
    ``hot_rows`` are few (at most rows / hot_rows), so their list is broadcast;
    their rows are spread over ``salts`` tasks and their ``per_key`` row is repeated.
    """
    hot = per_key.filter(F.col(count) > hot_rows).select(key, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    copies = F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = per_key.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"]).drop("_salt", "_hot")
