"""Writers. Output always goes to a new folder; input is never overwritten.

Wide results are written in parallel, one folder per file or category. Only one-row
summaries and lists that are capped by definition are written as single files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..operators import index as idx, profile, rules


def record_json(fields: tuple[str, ...] = vocab.RECORD_FIELDS, extra: str | None = "extra") -> Column:
    """A record as one JSON line, with the fields outside the record shape appended."""
    body = F.to_json(F.struct(*fields))
    if extra is None:
        return body
    more = F.to_json(F.col(extra))
    return F.when(
        F.size(extra) > 0,
        F.concat(F.left(body, F.length(body) - 1), F.lit(","), F.substr(more, F.lit(2))),
    ).otherwise(body)


def write_clean(repaired: DataFrame, path: str) -> None:
    """Repaired records as JSON lines, one folder per input file, in input order.

    Ranges split a large file over many tasks; part files are in order by name.
    """
    write_lines(repaired.select("source_file", "pos", record_json().alias("value")), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (source_file, pos, value) in the layout that ``jsonl.scan_lines`` reads back."""
    (
        lines.repartitionByRange("source_file", "pos")
        .sortWithinPartitions("source_file", "pos")
        .drop("pos")
        .write.partitionBy("source_file")
        .text(path)
    )


def write_flat_index(records: DataFrame, path: str, version: str, generated_at: str) -> None:
    idx.flat_items(records).write.json(f"{path}/items")
    idx.flat_meta(records, version, generated_at).coalesce(1).write.json(f"{path}/meta")


def write_compact_index(compact: DataFrame, path: str) -> None:
    """Parquet ordered by the facet most queries use, so row groups can be skipped."""
    compact.repartitionByRange("c", "pos").sortWithinPartitions("c", "pos").write.parquet(path)


def write_by_category(records: DataFrame, path: str) -> None:
    """Full records, partitioned by category for pruned point lookups.

    A range on (category, pos) gives a large category many files and a small one few.
    """
    (
        records.repartitionByRange("category", "pos")
        .sortWithinPartitions("category", "pos")
        .write.partitionBy("category")
        .parquet(path)
    )


def write_dimension_and_stats(records: DataFrame, labels: DataFrame, path: str) -> None:
    profile.category_dimension(records, "category", "subcategory", labels).orderBy(
        F.col("n").desc()
    ).coalesce(1).write.json(f"{path}/meta")
    profile.record_stats(records).coalesce(1).write.json(f"{path}/stats")
    counts = profile.facet_counts(records, profile.record_facets(), "pos")
    counts.write.parquet(f"{path}/facets")
    profile.top_values(counts, vocab.TOP_N).coalesce(1).write.json(f"{path}/top")


def write_validation_report(summary: DataFrame, found: DataFrame, path: str, shown: int = vocab.REPORT_ERRORS_MAX) -> None:
    """Summary, the first errors in input order as text, and the full violations table."""
    summary.coalesce(1).write.json(f"{path}/summary")
    errors = found.filter(F.col("kind") == rules.IMPERATIVE)
    (
        rules.as_messages(errors).orderBy("pos", "message").limit(shown)
        .select(F.col("message").alias("value")).coalesce(1).write.text(f"{path}/errors")
    )
    found.write.parquet(f"{path}/violations")


def write_duplicate_report(summary: DataFrame, sections: dict[str, DataFrame], ids: dict[str, DataFrame], members: dict[str, DataFrame], path: str) -> None:
    """Summary, one capped list per section, the ids of entries and all members in long form."""
    summary.coalesce(1).write.json(f"{path}/summary")
    for name, section in sections.items():
        section.coalesce(1).write.json(f"{path}/{name}")
    for name, rows in ids.items():
        rows.write.json(f"{path}/{name}")
    for name, rows in members.items():
        rows.write.parquet(f"{path}/members/{name}")
