"""Published tables that let a search read a part of the collection only.

* Posting lists: one row per distinct run of three characters of a row's haystack, in
  buckets by hash. A text search reads the lists of its own runs, keeps the rows that have
  all of them, fetches those rows' cells and verifies them.
* Record lookup: records in buckets by hash of the id, with Bloom filters on the id.
* Ranks: the place of every row in each sort order, in blocks, so a page is a range read.

The number of buckets, cells and blocks follows the number of rows. It is part of the
folder's name scheme (``of=N/bucket=K``), so readers need nothing else to find theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from .. import vocab
from ..session import cut_lineage, release
from .search import SORTS, Query, _order, matching

GRAM = 3
ROWS_PER_BUCKET = 500_000
ROWS_PER_BLOCK = 50_000
#: Bytes of records that one task sorts and writes, about.
BYTES_PER_TASK = 64 << 20


def _buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def _bucket(key: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts and 8 for each other plain value; nested ones as JSON."""
    plain, nested = F.lit(0).cast("long"), []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            plain = plain + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(kind, (ArrayType, MapType, StructType, VariantType)):
            nested.append(F.col(f"`{field.name}`"))
        else:
            plain = plain + F.lit(8)
    return plain + F.octet_length(F.to_json(F.struct(*nested))) if nested else plain


def _write_shape(df: DataFrame, path: str) -> None:
    """A table of no rows that tells readers the columns, also of an empty collection."""
    df.limit(0).write.parquet(f"{path}/columns")


def _read(spark: SparkSession, path: str, part: str, folders: str) -> DataFrame:
    """Part of a published folder; ``folders`` are the columns its folder names give."""
    shape = spark.read.parquet(f"{path}/columns").schema
    shape = StructType([*shape.fields, *StructType.fromDDL(folders).fields])
    return spark.read.schema(shape).parquet(f"{path}/{part}")


def _grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(1)), F.lit(1))
    some = F.char_length(text) >= GRAM
    return F.array_distinct(F.when(some, F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def write_text_index(index: DataFrame, path: str, per_bucket: int = ROWS_PER_BUCKET, per_cell: int = ROWS_PER_BLOCK) -> None:
    """Posting lists and cells of the compact index, below ``path``.

    A list is spread over its bucket's files by row, so a run that all rows have is no
    task's burden; files are sorted by run, and its row groups alone are read.
    """
    _write_shape(index, path)
    index = cut_lineage(index, "index")
    cells = _buckets_for(index.count(), per_cell)
    rows = index.withColumn("cell", _bucket(F.col("pos"), cells))
    rows.repartition("cell").withColumn("of", F.lit(cells)).write.partitionBy("of", "cell").parquet(f"{path}/rows")
    postings = rows.select("pos", "cell", F.explode(_grams(F.col("haystack"))).alias("gram"))
    buckets = _buckets_for(postings.count(), per_bucket)
    spread = F.pmod(F.xxhash64("pos"), F.lit(8))
    (
        postings.withColumn("bucket", _bucket(F.col("gram"), buckets)).withColumn("of", F.lit(buckets))
        .repartition("bucket", spread).sortWithinPartitions("of", "bucket", "gram", "pos")
        .write.partitionBy("of", "bucket").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    )
    release(index)


def search_text(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """Rows of the index that ``search.matching`` finds, read through the posting lists.

    Texts shorter than a run scan all rows. Facets are tested on the rows fetched.
    """
    rows = _read(spark, path, "rows", "of int, cell int")
    wanted = query.text.strip().lower()
    runs = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    out = matching(rows, query)
    if runs:
        lists = spark.read.schema("pos long, cell int, gram string, of int, bucket int").parquet(f"{path}/postings")
        # Tests on the folders' columns are settled before any file is read.
        own = [(F.col("bucket") == _bucket(F.lit(r), F.col("of"))) & (F.col("gram") == r) for r in runs]
        held = own[0]
        for test in own[1:]:
            held = held | test
        near = (
            lists.filter(F.col("gram").isin(runs) & held)
            .groupBy("cell", "pos").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs)).select("cell", "pos")
        )
        # The cells of the rows found prune the folders of rows at run time.
        out = out.join(near, ["cell", "pos"], "left_semi")
    return out.drop("of", "cell")


def write_lookup(
    records: DataFrame, path: str, id: str = "id", pos: str = "pos", per_bucket: int = ROWS_PER_BUCKET, per_task: int = BYTES_PER_TASK
) -> None:
    """Records in buckets by hash of the id. Null ids can't be looked up and are left out.

    Tasks take ranges of (bucket, id, pos) of about ``per_task`` bytes: a bucket of wide
    records, or a common id, is several files, each sorted by id. ``pos`` tells records apart.
    """
    _write_shape(records, path)
    named = records.filter(F.col(id).isNotNull())
    rows, size = named.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(named)), F.lit(0))).first()
    buckets = _buckets_for(rows, per_bucket)
    (
        named.withColumn("bucket", _bucket(F.col(id).cast("string"), buckets))
        .repartitionByRange(_buckets_for(size, per_task), "bucket", id, pos).sortWithinPartitions("bucket", id)
        .write.option(f"parquet.bloom.filter.enabled#{id}", "true").option("parquet.block.size", 8 << 20)
        .partitionBy("bucket").parquet(f"{path}/of={buckets}")
    )


def look_up(spark: SparkSession, path: str, value, id: str = "id", pos: str = "pos") -> DataFrame:
    """The first record, by ``pos``, of an id: reads one bucket."""
    from urllib.parse import unquote

    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(found)
    name = next(unquote(s.getPath().getName()) for s in listed if s.getPath().getName().startswith("of="))
    buckets = int(name.removeprefix("of="))
    rows = _read(spark, path, name, "bucket int")
    number = spark.range(1).select(_bucket(F.lit(value).cast("string"), buckets)).first()[0]
    hits = rows.filter((F.col("bucket") == number) & (F.col(id) == F.lit(value))).drop("bucket")
    return hits.orderBy(pos).limit(1)


def write_ranks(index: DataFrame, path: str, per_block: int = ROWS_PER_BLOCK) -> None:
    """Every sort order of the index, numbered from 0 and cut into blocks of ``per_block`` rows.

    The index is computed once. Range partitions of the order are sorted and counted, and
    prefix sums of the counts number the rows, so no task sees more than its range; blocks are
    written from there, as ranges are stretches of them. ``pos`` is the last part of each order
    and must be unique.
    """
    _write_shape(index, path)
    index = cut_lineage(index, "index")
    n = index.count()
    # Rows of a sorted partition are numbered as they come; the partition's own number is in the higher bits.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    for sort in SORTS:
        order = _order(sort, "q", "t", "pos")
        cut = cut_lineage(
            index.repartitionByRange(_buckets_for(n, per_block), *order).sortWithinPartitions(*order)
            .withColumns({"part": F.spark_partition_id(), "nth": nth}),
            "ranges",
        )
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = cut.groupBy("part").agg(F.count("*").alias("n")).select(
            "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        )
        # One row per range, that is per block: few enough to be broadcast.
        ranked = cut.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("nth"))
        block = F.call_function("div", F.col("rank"), F.lit(per_block))
        (
            ranked.drop("part", "nth", "base").withColumn("block", block)
            .sortWithinPartitions("block", "rank")
            .write.partitionBy("block").parquet(f"{path}/sort={sort}/of={per_block}")
        )
        release(cut)
    release(index)


def ranked_page(
    spark: SparkSession, path: str, sort: str = "relevance", number: int = 0, size: int = vocab.PAGE_SIZE, per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """One page of all rows, with their rank: a range of one or two blocks, nothing is sorted."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}, use one of {SORTS}")
    first, last = number * size, (number + 1) * size - 1
    rows = _read(spark, path, f"sort={sort}/of={per_block}", "rank long, block long")
    blocks = F.col("block").between(first // per_block, last // per_block)
    return rows.filter(blocks & F.col("rank").between(first, last)).drop("block")
