"""Where each repeated key of arriving rows was first seen, across batches.

Each batch reduces its rows to one per key before the shuffle, looks those keys up among
the ones kept from earlier batches, and keeps only keys it saw for the first time. A key
that holds a third of all rows is therefore one row in the look-up, and its own rows are
salted when they are told the place; keyed streaming state would bring them all to one
task. Folders are named after the batch, so a batch that is replayed replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ordering import join_per_key
from ..session import cut_lineage, release, remove
from ..sources.publication import listed


def first_seen_sink(
    rows: DataFrame, target: str, checkpoint: str, keep_batches: int | None = None
) -> DataStreamWriter:
    """Write later occurrences of keys, each with the place of the first one.

    ``rows`` has key, order and place, and may have other columns, which stay. Within a
    batch the first row is that of least order (unique within the batch); earlier batches
    come first. Null keys are no keys. Keys that were first seen more than ``keep_batches``
    batches ago are forgotten and count as new; None keeps them for ever.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = cut_lineage(batch.filter(F.col("key").isNotNull()), "arrived")
        own = mine.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "place")).alias("first")
        )
        oldest = -1 if keep_batches is None else batch_id - keep_batches
        kept = [k for k in listed(spark, f"{target}/seen") if oldest <= k < batch_id]
        if kept:
            seen = spark.read.parquet(*[f"{target}/seen/{k}" for k in kept])
            own = own.join(seen.select("key", F.col("place").alias("seen_at")), "key", "left")
        else:
            own = own.withColumn("seen_at", F.lit(None).cast(mine.schema["place"].dataType))
        own = cut_lineage(own, "own-keys")
        new = own.filter(F.col("seen_at").isNull()).select("key", F.col("first.place").alias("place"))
        new.write.mode("overwrite").parquet(f"{target}/seen/{batch_id}")
        known = own.filter(F.col("seen_at").isNotNull() | (F.col("n") > 1))
        later = (
            join_per_key(mine, known, "key", "order")
            .filter(F.col("seen_at").isNotNull() | (F.col("order") > F.col("first.order")))
            .withColumn("seen_at", F.coalesce("seen_at", "first.place"))
        )
        later.select(*mine.columns, "seen_at").write.mode("overwrite").parquet(f"{target}/repeats/{batch_id}")
        for used in (mine, own):
            release(used)
        for k in listed(spark, f"{target}/seen"):
            # A replay of this batch reads those from ``oldest`` on again.
            if k < oldest:
                remove(spark, f"{target}/seen/{k}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_repeats(spark: SparkSession, target: str) -> DataFrame:
    """Later occurrences found in all complete batches."""
    done = listed(spark, f"{target}/repeats")
    if not done:
        raise FileNotFoundError(f"no complete batch below {target}")
    return spark.read.parquet(*[f"{target}/repeats/{k}" for k in done])
