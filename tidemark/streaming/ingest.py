"""Streaming ingest: row rules and exact-duplicate removal for files that keep arriving.

Rules are row-wise, so the batch column functions serve the stream unchanged. Sinks
are written per micro-batch into a folder named after the batch id; a batch that is
replayed after a failure overwrites its own folder, so output is exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text, variants as V
from ..operators import rules
from ..sources.jsonl import decode


def arriving_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of new files. A stream has no stable line numbers; the file name is kept."""
    return (
        spark.readStream.option("pathGlobFilter", pattern)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_name").alias("source_file"),
            F.lit(None).cast("long").alias("line_num"),
            F.lit(None).cast("long").alias("pos"),
        )
    )


def checked_lines(lines: DataFrame) -> DataFrame:
    """Lines with their reason if unreadable, else with the rules they break."""
    checked = rules.with_hits(decode(lines).lines)
    return checked.select(
        "source_file", "line_num", "pos", "reason", "raw",
        V.text_at("rec", "id").alias("id"),
        F.when(F.col("reason").isNull(), F.col("hits")).alias("hits"),
    )


def validated_sink(lines: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Route arriving lines to valid records, violations and quarantine tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Parsed and checked once; the three tables are written from the outcome.
        outcome = checked_lines(batch).persist()
        try:
            readable = outcome.filter(F.col("reason").isNull())
            parts = {
                "valid": readable.filter(rules.is_valid()).select("source_file", "raw"),
                "violations": rules.explode_hits(readable).drop("line_num", "pos"),
                "quarantine": outcome.filter(F.col("reason").isNotNull()).select("source_file", "reason", "raw"),
            }
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        finally:
            outcome.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def first_by_fingerprint(
    stream: DataFrame,
    content: Column,
    event_time: str | None,
    keep_for: str = "7 days",
    spread_by: Column | None = None,
    salts: int = 64,
) -> DataFrame:
    """Drop rows whose token fingerprint was seen before, adding it as ``fingerprint``.

    State is kept for ``keep_for`` of ``event_time``. A stream without an event time has
    to say so by passing None; its state is kept for ever (use the RocksDB state store).

    Deduplication of a stream has no map-side step. When one text may make up a large
    share of the rows, give ``spread_by``, a column that differs between copies: copies
    are then reduced to one per salt in ``salts`` tasks before they meet in one.
    """
    marked = stream.withColumn("fingerprint", text.fingerprint(content))
    if event_time is not None:
        marked = marked.withWatermark(event_time, keep_for)

    def reduce(df: DataFrame, *keys: str) -> DataFrame:
        return df.dropDuplicates(keys) if event_time is None else df.dropDuplicatesWithinWatermark(keys)

    if spread_by is None:
        return reduce(marked, "fingerprint")
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return reduce(reduce(salted, "fingerprint", "_salt").drop("_salt"), "fingerprint")


def table_sink(stream: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
