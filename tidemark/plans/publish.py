"""Publishing job: flat index, compact index, records by category, dimension and stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import variants as V
from ..operators import index as idx, lookups, profile
from ..sources import jsonl, manifest, sinks

STRINGS = (
    "id", "version", "category", "subcategory", "title", "slug", "language", "difficulty",
    "audience", "use_case", "industry", "prompt", "negative_prompt", "created_by_agent", "batch",
)


def typed_records(decoded: jsonl.Decoded) -> DataFrame:
    """Records as typed columns, nothing repaired; wrongly typed parts are null."""
    rec = "rec"
    style = ", ".join(f"{k} string" for k in vocab.STYLE_FIELDS)
    tech = "framework string, language string, styling string, animation string, optional_libraries array<string>"
    card = "headline string, summary string, preview_label string, search_keywords array<string>"
    scores = ", ".join(f"{k} int" for k in vocab.SCORE_FIELDS)
    objects = {"style": style, "tech_stack": tech, "website_card": card, "quality": scores}
    return decoded.records.select(
        "source_file",
        "pos",
        *[V.text_at(rec, f).alias(f) for f in STRINGS],
        *[V.strings_at(rec, f).alias(f) for f in ("acceptance_criteria", "tags")],
        *[V.struct_at(rec, fields, f).alias(f) for f, fields in objects.items()],
    )


def run(
    spark: SparkSession,
    source: str,
    target: str,
    version: str = "1.0.0",
    generated_at: str = "",
    name: str = "records",
    gates: dict[str, bool] | None = None,
) -> None:
    """Write all published tables below ``target``. ``gates`` are the quality gates the
    manifest states; gates not given are stated as not met."""
    records = typed_records(jsonl.read_records(spark, source)).persist()
    try:
        sinks.write_flat_index(records, f"{target}/flat", version, generated_at)
        compact = idx.compact_items(records)
        sinks.write_compact_index(compact, f"{target}/index")
        lookups.write_text_index(compact, f"{target}/text")
        lookups.write_ranks(compact, f"{target}/ranks")
        lookups.write_lookup(records, f"{target}/lookup")
        sinks.write_by_category(records, f"{target}/records")
        sinks.write_dimension_and_stats(records, idx.category_dimension(spark), target)
        profile.record_profile(records).write.json(f"{target}/profile")
        files = records.filter("category is not null").groupBy("category").agg(
            F.min("source_file").alias("file"), F.count(F.lit(1)).alias("count")
        )
        met = {g: bool((gates or {}).get(g)) for g in manifest.GATES}
        built = manifest.build_manifest(files, name, version, "search", "record", met)
        built.coalesce(1).write.json(f"{target}/manifest")
    finally:
        records.unpersist()
