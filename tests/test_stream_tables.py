"""Streams of tables that are one file or a folder of files."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.sources.tables import stream_table

STREAMS = [n for n in entry.queries() if n.startswith("stream_")]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, once as given and once as folders of three files."""
    given, dealt = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("dealt"))
    for name in ("documents", "events"):
        spark.read.parquet(f"{given}/{name}.parquet").repartition(3).write.parquet(f"{dealt}/{name}.parquet")
    return given, dealt


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_files_and_folders(spark, folders, name):
    run = entry.queries()[name]
    whole, dealt = (rows(run(spark, folder)) for folder in folders)
    assert dealt and dealt == whole


def test_stream_of_one_file_leaves_its_neighbours(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/made")
    part = next(f for f in os.listdir(tmp_path / "made") if f.startswith("part-"))
    for name in ("a.parquet", "b.parquet"):
        (tmp_path / name).write_bytes((tmp_path / "made" / part).read_bytes())
    seen = stream_table(spark, f"{tmp_path}/a.parquet")
    seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*")).first()[0] == 5
