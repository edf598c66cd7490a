"""Cleanup job: repair all records of a folder and write them to a new one."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import repair
from ..sources import jsonl, sinks


def run(spark: SparkSession, source: str, target: str) -> None:
    """Write repaired records to ``target/data`` and per-file counters to ``target/counters``."""
    lines = jsonl.read_records(spark, source).lines.persist()
    try:
        decoded = jsonl.Decoded(lines)
        repaired = repair.repair_records(decoded.records)
        sinks.write_clean(repaired, f"{target}/data")
        repair.repair_counters(lines, repaired).coalesce(1).write.json(f"{target}/counters")
    finally:
        lines.unpersist()
