"""Contiguous shards of equal bytes, from global prefix sums of document sizes.

Documents are ordered by id. Each range partition of that order contributes one total;
prefix sums of the totals are the bases of the partitions, and a running sum inside a
partition completes the global position of each document. A document belongs to the shard
in which its middle byte falls, so shards are contiguous and no shard is further from its
target than half a document at either end.

Only (id, size, checksum) is ever shuffled. Equal ids, null ids among them, are told apart
by row position, so a repeated id doesn't keep its rows in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.registry import cells_for, query, table
from tidemark.session import cut_lineage

SHARDS = 24
ROW_OVERHEAD = 8
ROWS_PER_CELL = 50_000


def balanced_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = ROW_OVERHEAD,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus ``overhead`` (null text: no bytes, checksum of the
    empty string). slot numbers the rows of a shard from 0 without gaps. Rows with a null
    id come first; rows of equal id keep an arbitrary order. Empty input gives no rows.
    Other columns of ``docs`` are ignored. More shards than rows leave shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    cells = cells_for(docs.select(id_col).count(), rows_per_cell)
    placed = cut_lineage(
        narrow.repartitionByRange(cells, F.col("id").asc_nulls_first(), "row").withColumn(
            "cell", F.spark_partition_id()
        ),
        "shards",
    )

    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = totals.select(
        "cell",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("cell").orderBy(F.col("id").asc_nulls_first(), "row")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.expr(f"((2 * (base_bytes + end_bytes) - size) * {shards}) div (2 * all_bytes)")
    ordered = (
        placed.withColumn("end_bytes", F.sum("size").over(upto))
        .withColumn("nth", F.row_number().over(inside))
        .join(bases, "cell")
        .select(
            "id", "size", "text_crc32",
            (F.col("base_rows") + F.col("nth") - 1).alias("nth"),
            middle.cast("int").alias("shard"),
        )
    )
    first = ordered.groupBy("shard").agg(F.min("nth").alias("first"))
    return ordered.join(first, "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )


#: DuckDB has no crc32, so it is folded over the bytes with the table of the polynomial.
_CRC = """
crc_step(n) AS (SELECT range FROM range(256)),
crc_rows AS (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM crc_step),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_rows),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(octet_length(encode(text))),
      lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS crc
  FROM texts, crc_table)"""

SQL = f"""
WITH {_CRC},
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(documents.text, '')))::BIGINT + {ROW_OVERHEAD} AS size, crc
  FROM documents JOIN crcs ON crcs.text = coalesce(documents.text, '')),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total
  FROM sized),
cut AS (SELECT *, (((2 * upto - size) * {SHARDS}) // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""


@query(SQL)
def op9_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes."""
    placed = balanced_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
