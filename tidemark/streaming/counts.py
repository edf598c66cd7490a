"""Counts over files that keep arriving, each batch counted exactly once.

A micro-batch writes its partial counts to a folder named after its id, so a batch that is
replayed replaces itself. From time to time all partials are folded into one table, named
after the last batch in it. Readers take the newest complete fold and the batches after it;
a fold that was cut off has no success mark and is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import variants as V
from ..operators.profile import facet_counts
from ..session import remove
from ..sources.jsonl import decode
from ..sources.publication import listed

FOLD_EVERY = 64


def record_counts(lines: DataFrame) -> DataFrame:
    """(facet, value, n) of a batch of lines: records by category, difficulty and language,
    and lines, readable and unreadable ones by file. Null and empty values are ignored."""
    facts = decode(lines).lines.select(
        "source_file", "reason",
        *[V.text_at("rec", f).alias(f) for f in ("category", "difficulty", "language")],
    )
    fine = F.col("reason").isNull()
    facets = {f: F.when(fine, F.col(f)) for f in ("category", "difficulty", "language")}
    facets |= {
        "lines": F.col("source_file"),
        "valid": F.when(fine, F.col("source_file")),
        "invalid": F.when(~fine, F.col("source_file")),
    }
    return facet_counts(facts, facets)


def counted_sink(
    rows: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    fold_every: int = FOLD_EVERY,
) -> DataStreamWriter:
    """Keep the counts that ``count`` makes of each batch: key columns and ``n``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{target}/batches/{batch_id}")
        if (batch_id + 1) % fold_every == 0:
            fold(batch.sparkSession, target, batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def fold(spark: SparkSession, target: str, upto: int) -> None:
    """Fold all batches up to ``upto`` into one table and delete what the fold before it held.

    The batches of this fold stay until the next one, so a replay of batch ``upto`` finds
    the same input.
    """
    before = [k for k in listed(spark, f"{target}/folded") if k < upto]
    read_counts(spark, target, upto, folds=before).write.mode("overwrite").parquet(f"{target}/folded/{upto}")
    last = max(before, default=-1)
    for k in listed(spark, f"{target}/batches"):
        if k <= last:
            remove(spark, f"{target}/batches/{k}")
    for k in before:
        if k != last:
            remove(spark, f"{target}/folded/{k}")


def read_counts(
    spark: SparkSession, target: str, upto: int | None = None, folds: list[int] | None = None
) -> DataFrame:
    """The counts of all complete batches (up to ``upto``): key columns and ``n``."""
    folds = listed(spark, f"{target}/folded") if folds is None else folds
    folds = [k for k in folds if upto is None or k <= upto]
    last = max(folds, default=-1)
    batches = [k for k in listed(spark, f"{target}/batches") if k > last and (upto is None or k <= upto)]
    paths = [f"{target}/folded/{last}"] * bool(folds) + [f"{target}/batches/{k}" for k in batches]
    if not paths:
        raise FileNotFoundError(f"no complete batch below {target}")
    parts = spark.read.parquet(*paths)
    return parts.groupBy(*[c for c in parts.columns if c != "n"]).agg(F.sum("n").alias("n"))
