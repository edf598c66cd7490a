"""Counts, distributions, distinct counts, averages and top lists by facet.

Everything starts from one pass that aggregates map-side; later steps only see
aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab


def count_by(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(
        F.count(F.lit(1)).alias("n")
    )


def with_share(counts: DataFrame, n: str = "n", places: int = 1) -> DataFrame:
    """Add ``pct``: percent of the total. The total is a scalar subquery, not a window."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn("pct", F.round(F.col(n) * 100.0 / total, places))


def facet_counts(
    df: DataFrame, facets: Mapping[str, Column], pos: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., facet, value, n[, first_pos]) in one pass; null and empty values are ignored."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), c.cast("string").alias("value")) for f, c in facets.items()]
    )
    aggs = [F.count(F.lit(1)).alias("n")]
    carry = list(by)
    if pos is not None:
        carry.append(pos)
        aggs.append(F.min(pos).alias("first_pos"))
    rows = df.select(*carry, F.explode(pairs).alias("p")).select(*carry, "p.*")
    return rows.filter(F.coalesce("value", F.lit("")) != "").groupBy(*by, "facet", "value").agg(*aggs)


def top_values(counts: DataFrame, limits: Mapping[str, int], tie: str = "first_pos") -> DataFrame:
    """The most frequent values per facet; ties go to the value seen first."""
    limit = F.lit(None).cast("int")
    for facet, n in limits.items():
        limit = F.when(F.col("facet") == facet, n).otherwise(limit)
    order = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col(tie))
    return (
        counts.filter(F.col("facet").isin(*limits))
        .withColumn("rank", F.row_number().over(order))
        # The constant bound lets Spark limit each task before the shuffle.
        .filter(F.col("rank") <= max(limits.values()))
        .filter(F.col("rank") <= limit)
    )


def distinct_counts(df: DataFrame, columns: Mapping[str, Column], approximate: bool = False) -> DataFrame:
    """One row of distinct counts; null and empty values do not count."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.nullif(c.cast("string"), F.lit(""))).alias(name) for name, c in columns.items()])


def average(c: Column, places: int = 2) -> Column:
    """Average of the numeric values, null when there are none."""
    return F.round(F.avg(c), places)


def category_dimension(df: DataFrame, category: str, subcategory: str, labels: DataFrame | None = None) -> DataFrame:
    """(key, label, n, subcategories): the label falls back to the key.

    Subcategories are deduplicated before they are collected, so the list is as long
    as the number of distinct values, not of rows. A column with very many values
    belongs in ``facet_counts(..., by=[category])``, which stays in long form.
    """
    per_value = df.groupBy(F.col(category).alias("key"), F.col(subcategory).alias("sub")).agg(
        F.count(F.lit(1)).alias("n")
    )
    out = per_value.groupBy("key").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list("sub")).alias("subcategories")
    )
    if labels is None:
        return out.withColumn("label", F.col("key"))
    return (
        out.join(labels.select("key", "label"), "key", "left")
        .withColumn("label", F.coalesce("label", "key"))
    )


def distribution_maps(counts: DataFrame, by: Sequence[str], facets: Sequence[str]) -> DataFrame:
    """Turn facet counts into one map column per facet, most frequent first.

    Meant for enumerated facets; one map holds all values of a facet.
    """
    aggs = []
    for facet in facets:
        pair = F.when(F.col("facet") == facet, F.struct((-F.col("n")).alias("o"), "value", "n"))
        ordered = F.array_sort(F.collect_list(pair))
        entries = F.transform(ordered, lambda p: F.struct(p["value"], p["n"]))
        aggs.append(F.map_from_entries(entries).alias(f"{facet}_distribution"))
    return counts.filter(F.col("facet").isin(*facets)).groupBy(*by).agg(*aggs)


def category_profile(
    df: DataFrame,
    category: str,
    distributions: Mapping[str, Column],
    distincts: Mapping[str, Column],
    averages: Mapping[str, Column],
) -> DataFrame:
    """Per category: count, distribution maps, distinct counts and averages.

    Distinct counts come from the facet counts, so the wide rows are aggregated once
    for facets and once for averages, both map-side.
    """
    facets = {**{f"d:{k}": c for k, c in distributions.items()}, **{f"u:{k}": c for k, c in distincts.items()}}
    counts = facet_counts(df, facets, by=[category])
    maps = distribution_maps(
        counts.withColumn("facet", F.regexp_replace("facet", "^d:", "")), [category], list(distributions)
    )
    uniques = counts.groupBy(category).agg(
        *[F.count_if(F.col("facet") == f"u:{k}").alias(f"unique_{k}") for k in distincts]
    )
    basics = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), *[average(c).alias(f"avg_{k}") for k, c in averages.items()]
    )
    return basics.join(maps, category, "left").join(uniques, category, "left")


def ordered_shares(counts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Shares over a fixed ordered list; a level without rows has 0.

    ``counts`` is (key, n); ``dimension`` is (key, label, rank).
    """
    total = counts.agg(F.sum("n")).scalar()
    return (
        dimension.join(counts, "key", "left")
        .select(
            "key", "label", "rank",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(F.col("n") / total, F.lit(0.0)).alias("share"),
        )
    )


def headline(df: DataFrame, category: Column, subcategory: Column, score: Column) -> DataFrame:
    """Total, categories, subcategories, average score and the score as percent of ten."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.nullif(category, F.lit(""))).alias("categories"),
        F.count_distinct(F.nullif(subcategory, F.lit(""))).alias("subcategories"),
        average(score).alias("avg_score"),
    ).withColumn("score_pct", F.round(F.col("avg_score") * 10, 0).cast("int"))


def record_facets() -> dict[str, Column]:
    """Facets of the record shape."""
    return {
        "difficulty": F.col("difficulty"),
        "framework": F.col("tech_stack.framework"),
        "language": F.col("language"),
        "animation": F.col("tech_stack.animation"),
        "styling": F.col("tech_stack.styling"),
        "industry": F.col("industry"),
        "audience": F.col("audience"),
        "visual_style": F.col("style.visual_style"),
    }


def record_stats(df: DataFrame) -> DataFrame:
    """One row of totals for published records."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("category").alias("distinct_categories"),
        F.count_distinct(F.nullif("subcategory", F.lit(""))).alias("distinct_subcategories"),
        F.count_distinct(F.nullif("tech_stack.framework", F.lit(""))).alias("distinct_frameworks"),
        F.count_distinct(F.nullif("industry", F.lit(""))).alias("distinct_industries"),
        F.count_distinct(F.nullif("style.visual_style", F.lit(""))).alias("distinct_visual_styles"),
        average(F.col("quality.website_readiness_score")).alias("avg_website_readiness"),
    )


def record_profile(df: DataFrame) -> DataFrame:
    """Category profile of the record shape."""
    return category_profile(
        df,
        "category",
        {"difficulty": F.col("difficulty"), "language": F.col("language"), "audience": F.col("audience")},
        {
            "subcategories": F.col("subcategory"),
            "industries": F.col("industry"),
            "visual_styles": F.col("style.visual_style"),
            "motion_styles": F.col("style.motion_style"),
            "layout_styles": F.col("style.layout_style"),
        },
        {k: F.col(f"quality.{k}") for k in vocab.SCORE_FIELDS},
    )
