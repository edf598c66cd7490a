"""Dataset manifest: reading, rules, building and reconciliation with real counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import variants as V
from ..operators.rules import DECLARATIVE, Rule, violations

MANIFEST_FIELDS = (
    "dataset_name", "version", "total_prompts",
    "categories", "format", "schema", "created_for", "quality_gates",
)
GATES = (
    "json_valid", "schema_valid", "duplicates_removed",
    "minimum_total_reached", "minimum_per_category_reached",
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row (rec VARIANT) per manifest file; manifests are small by nature."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.try_parse_json("value").alias("rec"))
    )


def manifest_categories(manifest: DataFrame) -> DataFrame:
    """(category, file, expected) of each listed category."""
    entry = F.explode(V.items_at("rec", "categories")).alias("e")
    return manifest.select(entry).select(
        V.text_at("e", "category").alias("category"),
        V.text_at("e", "file").alias("file"),
        V.long_at("e", "count").alias("expected"),
    )


def _missing(rec, field: str, *path: str) -> Rule:
    return Rule(
        "missing_field", ".".join((*path, field)), V.at(rec, *path, field).isNull(), F.lit(None),
        f"Missing required field: '{field}'", kind=DECLARATIVE, shows_observed=False,
    )


def _minimum(rec, path: tuple[str, ...], minimum: int) -> list[Rule]:
    name = ".".join(path)
    kind, value = V.type_at(rec, *path), V.long_at(rec, *path)
    return [
        Rule("type", name, kind.isNotNull() & (kind != "BIGINT"), kind, f"'{name}' has type ", kind=DECLARATIVE),
        Rule("minimum", name, (kind == "BIGINT") & (value < minimum), value, f"'{name}' is below its minimum: ", kind=DECLARATIVE),
    ]


def check_manifest(manifest: DataFrame, min_total: int = vocab.MIN_TOTAL, min_count: int = vocab.MIN_PER_CATEGORY) -> DataFrame:
    """(entry, rule, kind, field, observed, detail); ``entry`` is null for top-level rules."""
    rec = "rec"
    top = [_missing(rec, f) for f in MANIFEST_FIELDS]
    top += _minimum(rec, ("total_prompts",), min_total)
    for f in ("dataset_name", "version", "format", "schema", "created_for"):
        kind = V.type_at(rec, f)
        top.append(Rule("type", f, kind.isNotNull() & (kind != "STRING"), kind, f"'{f}' has type ", kind=DECLARATIVE))
    fmt = V.text_at(rec, "format")
    top.append(Rule("invalid_value", "format", fmt != "jsonl", fmt, "Invalid format: '", "'", DECLARATIVE))
    for g in GATES:
        kind = V.type_at(rec, "quality_gates", g)
        top.append(_missing(rec, g, "quality_gates"))
        top.append(
            Rule("type", f"quality_gates.{g}", kind.isNotNull() & (kind != "BOOLEAN"), kind,
                 f"'quality_gates.{g}' has type ", kind=DECLARATIVE)
        )
    entries = manifest.select(
        F.posexplode(V.items_at(rec, "categories")).alias("entry", "rec")
    )
    per_entry = [_missing(rec, f) for f in ("category", "file", "count")] + _minimum(rec, ("count",), min_count)
    for f in ("category", "file"):
        kind = V.type_at(rec, f)
        per_entry.append(Rule("type", f, kind.isNotNull() & (kind != "STRING"), kind, f"'{f}' has type ", kind=DECLARATIVE))
    whole = manifest.withColumn("entry", F.lit(None).cast("int"))
    return violations(whole, top, "entry").unionByName(violations(entries, per_entry, "entry"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer comparison of expected and real counts.

    ``expected`` is (category, expected), ``actual`` is (category, n); both have one
    row per category.
    """
    e, a = F.coalesce("expected", F.lit(0)), F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("n").isNull(), "absent")
        .when(F.col("expected").isNull(), "unlisted")
        .when(e == a, "match")
        .otherwise("differs")
    )
    return expected.join(actual, "category", "full_outer").select(
        "category", e.alias("expected"), a.alias("actual"), (a - e).alias("difference"), status.alias("status")
    )


def build_manifest(category_files: DataFrame, name: str, version: str, created_for: str, schema: str, gates: dict[str, bool]) -> DataFrame:
    """One-row manifest. ``category_files`` is (category, file, count), one row per category."""
    listed = category_files.agg(
        F.array_sort(F.collect_list(F.struct("file", "category", "count"))).alias("c"),
        F.sum("count").alias("total"),
    )
    entries = F.transform("c", lambda x: F.struct(x["category"].alias("category"), x["file"].alias("file"), x["count"].alias("count")))
    return listed.select(
        F.lit(name).alias("dataset_name"),
        F.lit(version).alias("version"),
        F.col("total").alias("total_prompts"),
        entries.alias("categories"),
        F.lit("jsonl").alias("format"),
        F.lit(schema).alias("schema"),
        F.lit(created_for).alias("created_for"),
        F.struct(*[F.lit(gates[g]).alias(g) for g in GATES]).alias("quality_gates"),
    )
