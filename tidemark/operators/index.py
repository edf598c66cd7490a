"""Projections that publish records: flat, compact, detail and card shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import text


def category_dimension(spark: SparkSession) -> DataFrame:
    """(key, label, tagline, rank) in display order."""
    rows = [(k, label, tag, i) for i, (k, label, tag) in enumerate(vocab.CATEGORY_DIMENSION, 1)]
    return spark.createDataFrame(rows, "key string, label string, tagline string, rank int")


def difficulty_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.DIFFICULTY_DIMENSION), "key string, label string, rank int")


def with_label(
    df: DataFrame, key: str, dimension: DataFrame, out: str, default: str | None, label: str = "label"
) -> DataFrame:
    """Look a key up in a small fixed dimension; unknown keys take the default label.

    The dimension is one of the fixed lists above (at most tens of rows).
    """
    names = dimension.select(F.col("key").alias("_key"), F.col(label).alias("_label"))
    fallback = F.col(key) if default is None else F.lit(default)
    return (
        df.join(F.broadcast(names), F.col(key) == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_label", fallback))
        .drop("_key", "_label")
    )


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or_no_items(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def flat_items(records: DataFrame) -> DataFrame:
    """The ten-column search index."""
    names = ("id", "title", "slug", "category", "subcategory", "difficulty")
    return records.select(
        *[_or_empty(F.col(c)).alias(c) for c in names],
        _or_empty(F.col("website_card.headline")).alias("headline"),
        _or_empty(F.col("website_card.summary")).alias("summary"),
        _or_no_items(F.col("tags")).alias("tags"),
        _or_no_items(F.col("website_card.search_keywords")).alias("search_keywords"),
    )


def flat_meta(records: DataFrame, version: str, generated_at: str) -> DataFrame:
    """One-row header of the flat index."""
    return records.agg(
        F.lit(version).alias("version"),
        F.count(F.lit(1)).alias("total_items"),
        F.lit(generated_at).alias("generated_at"),
        F.count_distinct("source_file").alias("source_files"),
    )


def compact_items(records: DataFrame) -> DataFrame:
    """The seventeen-column index behind cards and search, plus position and haystack.

    The haystack is stored so that a text filter does not rebuild it per query.
    """
    items = records.select(
        "pos",
        "id",
        F.col("title").alias("t"),
        F.col("slug").alias("s"),
        F.col("category").alias("c"),
        F.col("subcategory").alias("sc"),
        F.col("difficulty").alias("d"),
        F.col("audience").alias("a"),
        F.col("industry").alias("in"),
        _or_empty(F.col("tech_stack.framework")).alias("fw"),
        _or_empty(F.col("tech_stack.animation")).alias("an"),
        F.col("language").alias("lang"),
        _or_no_items(F.col("tags")).alias("tags"),
        text.or_default(F.col("website_card.headline"), F.col("title")).alias("hl"),
        _or_empty(F.col("website_card.summary")).alias("sum"),
        _or_empty(F.col("website_card.preview_label")).alias("pl"),
        _or_no_items(F.col("website_card.search_keywords")).alias("kw"),
        F.col("quality.website_readiness_score").alias("q"),
    )
    return items.withColumn("haystack", compact_haystack())


def compact_haystack() -> Column:
    return text.haystack(
        [F.col(c) for c in ("t", "hl", "sum", "fw", "in", "sc", "a")], [F.col("tags"), F.col("kw")]
    )


def detail_items(records: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Detail view: technology chips, four style pairs, four scores, summary."""
    libraries = _or_no_items(F.col("tech_stack.optional_libraries"))
    scalars = [F.col(f"tech_stack.{k}") for k in ("framework", "language", "styling", "animation")]
    chips = F.filter(F.concat(F.array(*scalars), libraries), lambda x: F.coalesce(x, F.lit("")) != "")
    style = [("Visual", "visual_style"), ("Layout", "layout_style"), ("Farben", "color_direction"), ("Motion", "motion_style")]
    scores = list(zip(("Specificity", "Originality", "Clarity", "Readiness"), vocab.SCORE_FIELDS))
    summary = F.nullif("website_card.summary", F.lit(""))
    if index is not None:
        records = records.join(index.select("pos", F.col("sum").alias("_sum")), "pos", "left")
        summary = F.coalesce(summary, "_sum")
    return records.select(
        "pos",
        "id",
        summary.alias("summary"),
        chips.alias("chips"),
        F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"style.{k}").alias("value")) for n, k in style]).alias("style"),
        "prompt",
        "negative_prompt",
        "acceptance_criteria",
        "tags",
        F.array(
            *[F.struct(F.lit(n).alias("name"), F.format_string("%.1f", F.col(f"quality.{k}").cast("double")).alias("value")) for n, k in scores]
        ).alias("scores"),
    )


def card_items(index: DataFrame, categories: DataFrame, difficulties: DataFrame) -> DataFrame:
    """Card view of compact items; labels come from the fixed dimensions."""
    first_category = vocab.CATEGORY_DIMENSION[0]
    fallback_difficulty = dict((k, label) for k, label, _ in vocab.DIFFICULTY_DIMENSION)[vocab.DIFFICULTY_DEFAULT]
    labelled = with_label(index, "c", categories, "category_label", first_category[1])
    labelled = with_label(labelled, "d", difficulties, "difficulty_label", fallback_difficulty)
    return labelled.select(
        "pos",
        "id",
        F.col("t").alias("title"),
        "category_label",
        "difficulty_label",
        text.or_default(F.col("hl"), F.col("sum")).alias("text"),
        F.transform(F.slice("tags", 1, 3), text.humanize).alias("tags"),
        F.col("fw").alias("framework"),
        F.when(F.col("q").isNotNull(), F.format_string("%.1f", F.col("q").cast("double"))).alias("score"),
        text.or_default(F.col("pl"), F.col("t")).alias("copy_text"),
    )


def category_showcase(dimension: DataFrame, counts: DataFrame) -> DataFrame:
    """Every listed category with its count, 0 when it has no rows."""
    return dimension.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
