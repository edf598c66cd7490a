"""Mergeable distinct counts, and the most frequent values without growing lists.

A sketch of a part (a file, a day, a category) is kept once; counts over any union of
parts merge the kept sketches and never read the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Base-2 logarithm of the registers of a distinct-count sketch.
LG_K = 12
#: Values a frequency sketch tracks for each group.
TRACKED = 1000


def distinct_error(lg_k: int = LG_K) -> float:
    """Standard error of a merged estimate, as a share of the distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(
    df: DataFrame, columns: Mapping[str, Column], by: Sequence[str] = (), lg_k: int = LG_K
) -> DataFrame:
    """(by..., one sketch per column); null and empty values do not count.

    A sketch has at most 2**lg_k bytes and a header, whatever the number of rows.
    """
    return df.groupBy(*by).agg(
        *[F.hll_sketch_agg(F.nullif(c.cast("string"), F.lit("")), lg_k).alias(name) for name, c in columns.items()]
    )


def merge_sketches(sketches: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the unions of parts, one row per ``by``."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(name).alias(name) for name in names])


def estimated(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct counts in place of the sketches."""
    return sketches.withColumns({name: F.hll_sketch_estimate(name) for name in names})


def unseen_bound(total: Column, tracked: int) -> Column:
    """Most occurrences of a value that a frequency sketch over ``total`` rows may leave out.

    A sketch of m counters errs by at most 3.5 / m of the rows; a value is left out if its
    lower bound isn't above that error, so twice the error bounds it.
    """
    counters = 1
    while counters < tracked / 0.75:
        counters *= 2
    return F.floor(total * (7.0 / counters))


def top_distribution(
    df: DataFrame, by: str, facets: Mapping[str, Column], k: int, tracked: int = TRACKED
) -> DataFrame:
    """(by, facet, value, n, rank, total): the ``k`` most frequent values per group and facet.

    Exact; ties go to the smaller value, null and empty values do not count, ``total`` is
    the number of rows with a value. A sketch per group names the candidates and one join
    counts them; Spark sends the candidates to the rows if they are few. Groups in which an
    untracked value could still be among the first ``k`` are counted in full, in long form,
    so no case is lost and nothing is gathered per group but ``tracked`` values.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), c.cast("string").alias("value")) for f, c in facets.items()])
    rows = df.select(F.col(by).alias("group"), F.explode(pairs).alias("p")).select("group", "p.*")
    rows = rows.filter(F.coalesce("value", F.lit("")) != "")
    # Groups are compared null-safely through a struct, which is never null itself.
    rows = rows.select(F.struct("group", "facet").alias("cell"), "value")
    found = rows.groupBy("cell").agg(
        F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("items"), F.count(F.lit(1)).alias("total")
    )
    candidates = found.select("cell", F.explode("items.item").alias("value"))
    counted = _ranked(rows.join(candidates, ["cell", "value"]), k)
    decided = (
        counted.groupBy("cell").agg(F.sum("n").alias("counted"), F.min("n").alias("least"), F.count(F.lit(1)).alias("kept"))
        .join(found.select("cell", "total"), "cell")
        .filter((F.col("counted") == F.col("total")) | ((F.col("kept") == k) & (F.col("least") > unseen_bound(F.col("total"), tracked))))
        .select("cell")
    )
    exact = _ranked(rows.join(decided, "cell", "left_anti"), k)
    return (
        counted.join(decided, "cell", "left_semi").unionByName(exact)
        .join(found.select("cell", "total"), "cell")
        .select(F.col("cell.group").alias(by), "cell.facet", "value", "n", "rank", "total")
    )


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("cell").orderBy(F.col("n").desc(), "value")
    counts = rows.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
