"""Counts, shares, top lists, profiles and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import index as idx, profile, sketches
from tidemark.sources import manifest
from tidemark.sources.tables import read_table

from . import query
from .duplicates import documents, part


def _table(spark, folder, name):
    return read_table(spark, f"{folder}/{name}.parquet")


@query(
    """SELECT source AS key, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
    FROM documents GROUP BY source"""
)
def category_counts(spark, folder):
    return profile.with_share(profile.count_by(_table(spark, folder, "documents"), "source"))


@query(
    """SELECT lang AS key, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
    FROM documents GROUP BY lang"""
)
def language_counts(spark, folder):
    return profile.with_share(profile.count_by(_table(spark, folder, "documents"), "lang"))


def _part_facets():
    return {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size"), "name": F.col("p_name")}


_FACETS = """SELECT facet, value, count(*) AS n, min(pos) AS first_pos FROM (
      SELECT 'brand' AS facet, p_brand AS value, p_partkey AS pos FROM part
      UNION ALL SELECT 'type', p_type, p_partkey FROM part
      UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), p_partkey FROM part
      UNION ALL SELECT 'name', p_name, p_partkey FROM part)
    WHERE value <> '' GROUP BY facet, value"""


@query(_FACETS)
def facet_counts(spark, folder):
    return profile.facet_counts(part(spark, folder), _part_facets(), "p_partkey")


@query(
    f"""SELECT facet, value, n, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY facet ORDER BY n DESC, first_pos) AS rank FROM ({_FACETS}))
    WHERE (facet = 'brand' AND rank <= 14) OR (facet = 'type' AND rank <= 4)
      OR (facet = 'size' AND rank <= 8) OR (facet = 'name' AND rank <= 16)"""
)
def facet_top_values(spark, folder):
    counts = profile.facet_counts(part(spark, folder), _part_facets(), "p_partkey")
    limits = {"brand": 14, "type": 4, "size": 8, "name": 16}
    return profile.top_values(counts, limits).drop("first_pos")


@query(
    f"""SELECT facet, value FROM (SELECT *,
        row_number() OVER (PARTITION BY facet ORDER BY n DESC, first_pos) AS rank FROM ({_FACETS}))
    WHERE (facet = 'brand' AND rank <= 10) OR (facet = 'name' AND rank <= 8)"""
)
def facet_options(spark, folder):
    counts = profile.facet_counts(part(spark, folder), _part_facets(), "p_partkey")
    return profile.top_values(counts, {"brand": 10, "name": 8}).select("facet", "value")


@query(
    """SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types,
      count(DISTINCT p_name) AS names, count(DISTINCT p_size) AS sizes FROM part"""
)
def distinct_counts(spark, folder):
    columns = {"brands": F.col("p_brand"), "types": F.col("p_type"), "names": F.col("p_name"), "sizes": F.col("p_size")}
    return profile.distinct_counts(part(spark, folder), columns)


@query(
    """SELECT d.source, round(avg(l.quality), 2) AS avg_quality, count(l.quality) AS labelled
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source"""
)
def average_scores(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "source")
    rows = docs.join(_table(spark, folder, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(
        profile.average(F.col("quality")).alias("avg_quality"), F.count("quality").alias("labelled")
    )


@query(
    """SELECT p_type AS key, count(*) AS n, p_type AS label,
      array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY p_type"""
)
def category_dimension(spark, folder):
    return profile.category_dimension(part(spark, folder), "p_type", "p_brand").select(
        "key", "n", "label", F.array_join("subcategories", ",").alias("brands")
    )


@query(
    """WITH j AS (SELECT d.source, d.lang, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
    m AS (SELECT source, array_to_string(list(lang || '=' || n ORDER BY n DESC, lang), ',') AS languages
      FROM (SELECT source, lang, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY source)
    SELECT j.source, count(*) AS n, any_value(m.languages) AS languages,
      count(DISTINCT lang) AS unique_langs, count(DISTINCT quality) AS unique_scores,
      round(avg(quality), 2) AS avg_quality, round(avg(toxic), 2) AS avg_toxic
    FROM j JOIN m USING (source) GROUP BY j.source"""
)
def category_profile(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "source", "lang")
    rows = docs.join(_table(spark, folder, "labels"), "doc_id", "left")
    profiled = profile.category_profile(
        rows,
        "source",
        {"lang": F.col("lang")},
        {"langs": F.col("lang"), "scores": F.col("quality")},
        {"quality": F.col("quality"), "toxic": F.col("toxic")},
    )
    entries = F.transform(F.map_entries("lang_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return profiled.withColumn("languages", F.array_join(entries, ",")).drop("lang_distribution")


_LEVELS = [("1-URGENT", "Urgent", 1), ("2-HIGH", "High", 2), ("5-LOW", "Low", 3), ("9-NEVER", "Never", 4)]


@query(
    """WITH d(key, label, rank) AS (VALUES ('1-URGENT', 'Urgent', 1), ('2-HIGH', 'High', 2), ('5-LOW', 'Low', 3), ('9-NEVER', 'Never', 4)),
    c AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1)
    SELECT d.key, label, rank, coalesce(n, 0) AS n,
      coalesce(n * 1.0 / (SELECT sum(n) FROM c), 0) AS share FROM d LEFT JOIN c USING (key)"""
)
def ordered_shares(spark, folder):
    counts = profile.count_by(_table(spark, folder, "orders"), "o_orderpriority")
    return profile.ordered_shares(counts, spark.createDataFrame(_LEVELS, "key string, label string, rank int"))


@query(
    """SELECT *, CAST(round(avg_score * 10) AS INT) AS score_pct FROM (
      SELECT count(*) AS total, count(DISTINCT p_type) AS categories, count(DISTINCT p_brand) AS subcategories,
        round(avg(p_size), 2) AS avg_score FROM part)"""
)
def headline_figures(spark, folder):
    return profile.headline(part(spark, folder), F.col("p_type"), F.col("p_brand"), F.col("p_size"))


@query(
    """WITH e AS (SELECT CASE WHEN source = 'src3' THEN 'src_absent' ELSE source END AS category,
        count(DISTINCT text) AS expected FROM documents GROUP BY 1),
    a AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY 1)
    SELECT category, coalesce(expected, 0) AS expected, coalesce(n, 0) AS actual,
      coalesce(n, 0) - coalesce(expected, 0) AS difference,
      CASE WHEN n IS NULL THEN 'absent' WHEN expected IS NULL THEN 'unlisted'
        WHEN n = expected THEN 'match' ELSE 'differs' END AS status
    FROM e FULL JOIN a USING (category)"""
)
def manifest_reconciliation(spark, folder):
    docs = _table(spark, folder, "documents")
    actual = profile.count_by(docs, "source", "category")
    expected = (
        docs.groupBy(F.when(F.col("source") == "src3", "src_absent").otherwise(F.col("source")).alias("category"))
        .agg(F.count_distinct(F.sha2("text", 256)).alias("expected"))
    )
    return manifest.reconcile(expected, actual)


@query(
    """WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i FROM documents GROUP BY source)
    SELECT CAST(NULL AS INT) AS entry, 'invalid_value' AS rule, 'format' AS field, 'Invalid format: ''csv''' AS detail
    UNION ALL SELECT NULL, 'missing_field', 'created_for', 'Missing required field: ''created_for'''
    UNION ALL SELECT NULL, 'type', 'quality_gates.schema_valid', '''quality_gates.schema_valid'' has type STRING'
    UNION ALL SELECT NULL, 'minimum', 'total_prompts', '''total_prompts'' is below its minimum: ' || (SELECT sum(n) FROM c)
    UNION ALL SELECT CAST(i AS INT), 'minimum', 'count', '''count'' is below its minimum: ' || n FROM c WHERE source < 'src15'
    UNION ALL SELECT CAST(i AS INT), 'missing_field', 'file', 'Missing required field: ''file''' FROM c WHERE source = 'src7'"""
)
def manifest_rules(spark, folder):
    """Rules over a manifest made from the counts per source, with some faults put in."""
    per_source = profile.count_by(_table(spark, folder, "documents"), "source")
    many = 10**9
    entry = F.struct(
        F.col("key").alias("category"),
        F.when(F.col("key") != "src7", F.concat("key", F.lit(".jsonl"))).alias("file"),
        F.when(F.col("key") < "src15", F.col("n")).otherwise(F.col("n") + 10 * many).alias("count"),
    )
    gates = F.struct(
        *[(F.lit("yes") if g == "schema_valid" else F.lit(True)).alias(g) for g in manifest.GATES]
    )
    # One entry per category: the list is as long as the category dimension.
    totals = per_source.agg(
        F.sum("n").alias("total_prompts"), F.array_sort(F.collect_list(entry)).alias("categories")
    )
    body = F.struct(
        F.lit("documents").alias("dataset_name"), F.lit("1").alias("version"), "total_prompts", "categories",
        F.lit("csv").alias("format"), F.lit("records").alias("schema"), gates.alias("quality_gates"),
    )
    made = totals.select(F.try_parse_json(F.to_json(body)).alias("rec"))
    return manifest.check_manifest(made, many, many).select("entry", "rule", "field", "detail")


@query(
    """SELECT r.r_name AS label, n.n_name AS key, count(c_custkey) AS n
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    GROUP BY 1, 2"""
)
def category_showcase(spark, folder):
    nation, region = _table(spark, folder, "nation"), _table(spark, folder, "region")
    listed = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("key"), "n_name", F.col("r_name").alias("label")
    )
    counts = profile.count_by(_table(spark, folder, "customer"), "c_nationkey")
    return idx.category_showcase(listed, counts).select("label", F.col("n_name").alias("key"), "n")


@query(
    """SELECT c_custkey, c_name, coalesce(n_name, 'NATION_0') AS nation_label
    FROM customer LEFT JOIN nation ON c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END = n_nationkey"""
)
def dimension_lookup(spark, folder):
    # Nation is a fixed list of 25 rows; every tenth customer asks for one that isn't in it.
    names = _table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")
    )
    asked = F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0)
    rows = _table(spark, folder, "customer").select("c_custkey", "c_name", asked.alias("c_nationkey"))
    return idx.with_label(rows, "c_nationkey", names, "nation_label", "NATION_0").drop("c_nationkey")


@query(
    """SELECT p_brand AS brand, facet, value, n, rank, CAST(total AS BIGINT) AS total FROM (
      SELECT *, row_number() OVER (PARTITION BY p_brand, facet ORDER BY n DESC, value) AS rank,
        sum(n) OVER (PARTITION BY p_brand, facet) AS total
      FROM (SELECT p_brand, 'type' AS facet, p_type AS value, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1, 3
        UNION ALL SELECT p_brand, 'name', p_name, count(*) FROM part WHERE p_name <> '' GROUP BY 1, 3
        UNION ALL SELECT p_brand, 'size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size IS NOT NULL GROUP BY 1, 3))
    WHERE rank <= 5"""
)
def top_distributions(spark, folder):
    """The five most frequent types, names and sizes of each brand."""
    facets = {"type": F.col("p_type"), "name": F.col("p_name"), "size": F.col("p_size")}
    return sketches.top_distribution(part(spark, folder), "p_brand", facets, 5).withColumnRenamed("p_brand", "brand")


@query(
    """SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags,
      true AS orders_close, true AS parts_close, true AS flags_close FROM lineitem"""
)
def sketched_distincts(spark, folder):
    """Distinct counts merged from one sketch per return flag lie within four standard errors."""
    lines = _table(spark, folder, "lineitem")
    columns = {"orders": F.col("l_orderkey"), "parts": F.col("l_partkey"), "flags": F.col("l_returnflag")}
    kept = sketches.distinct_sketches(lines, columns, ["l_returnflag"])
    merged = sketches.estimated(sketches.merge_sketches(kept, list(columns)), list(columns))
    exact = profile.distinct_counts(lines, columns)
    close = [
        (F.abs(merged.select(c).scalar() / F.col(c) - 1) <= 4 * sketches.distinct_error()).alias(f"{c}_close")
        for c in columns
    ]
    return exact.select(*columns, *close)
