"""Columnar input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: hash text-heavy tables over this many partitions as they are read.
#: For local runs on tables of a single row group; unset, the scan's own splits are kept.
SPREAD = "tidemark.spread"


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """Parquet table; ``spread_by`` is the column to hash by if the session asks for it."""
    df = spark.read.parquet(path)
    partitions = spark.conf.get(SPREAD, None)
    if spread_by is not None and partitions:
        df = df.repartition(int(partitions), spread_by)
    return df


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet table as a stream; the table is one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return stream.parquet(path)
    # A stream reads folders only, so a file is picked from its own by name.
    folder, name = target.getParent().toString(), target.getName()
    return stream.option("pathGlobFilter", name).parquet(folder)
