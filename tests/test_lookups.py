"""Posting lists, bucketed lookup and ranks against plain scans, and what their plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups, search


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        text = "" if i % 97 == 0 else " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(6))
        rows.append((i, f"id{i % 590}", rng.choice("xy"), rng.choice(["b", "A", "ä", "Z"]), rng.choice([None, 1, 2, 3]), text))
    return spark.createDataFrame(rows, "pos long, id string, c string, t string, q int, haystack string").repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_search_equals_scan(spark, index, tmp_path):
    path = str(tmp_path)
    lookups.write_text_index(index, path, per_bucket=500, per_cell=50)
    for text in ("", "a", "ab", "abc", "  ABC ", "c a", "ééé", "abcab", "abc abc", "zzz", "%_"):
        for filters in ({}, {"category": "x"}):
            query = search.Query(text, filters)
            got, want = lookups.search_text(spark, path, query), search.matching(index, query)
            assert sorted(r.pos for r in got.collect()) == sorted(r.pos for r in want.collect())
            assert sorted(got.columns) == sorted(index.columns)
    buckets = spark.read.parquet(f"{path}/postings").select("bucket").distinct().count()
    scans = [line for line in plan(lookups.search_text(spark, path, search.Query("abc"))).splitlines() if "FileScan" in line]
    rows, lists = (next(x for x in scans if f"/{kind}]" in x) for kind in ("rows", "postings"))
    assert buckets > 5 and re.search(r"PartitionFilters: \[.*bucket", lists)
    assert "dynamicpruning" in rows and "cell" in rows.split("PartitionFilters")[1]
    read = spark.read.parquet(f"{path}/postings").filter((F.col("bucket") == lookups._bucket(F.lit("abc"), F.col("of"))) & (F.col("gram") == "abc"))
    assert read.select(F.input_file_name().alias("f")).select(F.regexp_extract("f", "bucket=[0-9]+", 0)).distinct().count() == 1


def test_lookup_reads_one_bucket(spark, index, tmp_path):
    path = str(tmp_path)
    lookups.write_lookup(index.unionByName(index.limit(1).withColumn("id", F.lit(None).cast("string"))), path, per_bucket=40)
    for id in ("id3", "id589", "id0"):
        want = index.filter(F.col("id") == id).orderBy("pos").first()
        assert lookups.look_up(spark, path, id).first().asDict() == want.asDict()
    assert lookups.look_up(spark, path, "none").count() == 0
    text = plan(lookups.look_up(spark, path, "id3"))
    assert "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [IsNotNull(id), EqualTo(id,id3)]" in text


def test_ranked_pages_equal_sorted_pages(spark, index, tmp_path):
    path = str(tmp_path)
    lookups.write_ranks(index, path, per_block=70)
    for sort in search.SORTS:
        for number in (0, 1, 12, 13):
            got = lookups.ranked_page(spark, path, sort, number, per_block=70)
            assert "Sort" not in plan(got) and "Exchange" not in plan(got)
            rows = sorted(got.collect(), key=lambda r: r.rank)
            assert [r.pos for r in rows] == [r.pos for r in search.page(index, sort, number).collect()]
    with pytest.raises(ValueError):
        lookups.ranked_page(spark, path, "other")


def test_empty_index(spark, index, tmp_path):
    none = index.limit(0)
    lookups.write_ranks(none, f"{tmp_path}/ranks")
    lookups.write_lookup(none, f"{tmp_path}/lookup")
    lookups.write_text_index(none, f"{tmp_path}/text")
    assert lookups.ranked_page(spark, f"{tmp_path}/ranks").count() == 0
    assert lookups.look_up(spark, f"{tmp_path}/lookup", "id1").count() == 0
    assert lookups.search_text(spark, f"{tmp_path}/text", search.Query("abc")).count() == 0


def test_a_bucket_is_no_task_of_its_own(spark, tmp_path):
    """Wide records of one bucket, a third of them of one id, are dealt over tasks by their bytes."""
    wide = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("pos"), F.repeat(F.lit("x"), 200).alias("text")
    )
    lookups.write_lookup(wide, str(tmp_path), per_task=60_000)
    written = spark.read.parquet(f"{tmp_path}/of=1")
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1000
    assert lookups.look_up(spark, str(tmp_path), "hot").first().pos == 0
    assert lookups.look_up(spark, str(tmp_path), "2999").first().pos == 2999


@pytest.mark.parametrize("write", [lookups.write_ranks, lookups.write_text_index])
def test_index_is_computed_once(spark, index, tmp_path, write):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    write(index.mapInArrow(count, index.schema), str(tmp_path))
    assert seen.value == 600
