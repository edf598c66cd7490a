"""Target-distribution importance resampling of documents by hashed n-gram features.

Features are runs of consecutive words, hashed into a fixed number of buckets. Bucket counts
of the raw texts and of the target texts give each bucket an integer gain; a document's
weight is the sum of gains over its features, read from one array. Gumbel noise from a
hash of the id turns the greatest scores into a draw without replacement.

Scores are sorted in parallel by regular sampling. Every partition sorts its own rows (a
run) and writes them numbered; every ``step``-th row of each run is a sample, so a sample
stands for ``step`` rows wherever it comes from; equally spaced samples of the sorted
samples are the splitters. Runs are cut at the splitters, the pieces of a segment are
exchanged and merged in one task, and prefix sums of the segments' counts turn places
inside a segment into exact ranks. Ties are part of the splitters, so no score, however
common, makes a segment large.

What reaches the driver: bucket counts, counts, and at most ``SEGMENTS`` splitters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.pieces import blocks
from tidemark.llm.registry import query, table, text_of
from tidemark.session import cut_lineage

#: Fixed values of the draw.
BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
ROWS_PER_SEGMENT = 250_000
SEGMENTS = 4096
SAMPLES_PER_SEGMENT = 16
BLOCK_BYTES = 4 << 20
#: Features longer than this many bytes are hashed one by one.
LONG = 48


class Features:
    """Buckets of the features of many texts at once."""

    def __init__(self, buckets: int = BUCKETS, most_words: int = MOST_WORDS):
        import numpy as np

        self.buckets, self.most_words = buckets, most_words
        c = np.arange(256, dtype=np.uint8)
        upper = (c >= ord("A")) & (c <= ord("Z"))
        self.lower = np.where(upper, c + 32, c).astype(np.uint8)
        digit, letter = (c >= ord("0")) & (c <= ord("9")), (c >= ord("a")) & (c <= ord("z"))
        self.inside = digit | letter | (c >= 0x80)
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
        self.crc = crc.astype(np.uint32)

    def checksums(self, data, starts, ends):
        """CRC-32 of data[start:end] for each start and end, one byte of all at a time."""
        import zlib

        import numpy as np

        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        out = np.full(len(at), 0xFFFFFFFF, np.uint32)
        long = int(np.searchsorted(-size, -LONG))
        for j in range(min(LONG, int(size[0]) if len(size) else 0)):
            live = slice(long, int(np.searchsorted(-size, -j)))
            out[live] = self.crc[(out[live] ^ data[at[live] + j]) & 0xFF] ^ (out[live] >> np.uint32(8))
        out ^= np.uint32(0xFFFFFFFF)
        for k in range(long):
            out[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes())
        back = np.empty_like(out)
        back[order] = out
        return back

    def of(self, texts: list[bytes]):
        """(buckets of all features, text of each, number of words of each text)."""
        import numpy as np

        data = self.lower[np.frombuffer(b"\0".join(texts), np.uint8)]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = self.inside[data]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(begins, starts, side="right") - 1
        words = np.bincount(owner, minlength=len(texts))
        if self.most_words > 1:
            # Words with one blank between them, so that a run of words is one slice.
            sizes = ends - starts
            firsts = np.cumsum(sizes + 1) - sizes - 1
            packed = np.full(int((sizes + 1).sum()), ord(" "), np.uint8)
            shift = np.repeat(starts - firsts, sizes)
            place = np.arange(len(shift)) + np.repeat(np.arange(len(sizes)), sizes)
            packed[place] = data[place + shift]
            data, starts, ends = packed, firsts, firsts + sizes
        found = [self.checksums(data, starts, ends) % self.buckets]
        owners = [owner]
        for n in range(2, self.most_words + 1):
            run = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(owner) >= n else np.zeros(0, int)
            found.append(self.checksums(data, starts[run], ends[run + n - 1]) % self.buckets)
            owners.append(owner[run])
        return np.concatenate(found).astype(np.int64), np.concatenate(owners), words


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, most_words: int = MOST_WORDS):
    """Occurrences of each bucket over all texts, as an array; null texts have none."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        features, total = Features(buckets, most_words), np.zeros(buckets, np.int64)
        for block in blocks(batches, "text", BLOCK_BYTES):
            found, _, _ = features.of(block.column("text").to_pylist())
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    narrow = texts.select(text_of(text_col).cast("binary").alias("text"))
    per_task = narrow.mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in per_task.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw, target):
    """Integer gain of each bucket from its counts in the raw and the target texts."""
    import math

    import numpy as np

    buckets, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    ratio = ((target + 1).astype(float) * (all_raw + buckets)) / ((raw + 1).astype(float) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def scored(
    docs: DataFrame, gain, id_col: str, text_col: str, most_words: int = MOST_WORDS, seed: str = SEED
) -> DataFrame:
    """id, row, n_words, n_features, weight, score: one row per document."""

    def score(batches):
        import math

        import numpy as np
        import pyarrow as pa

        features = Features(len(gain), most_words)
        for block in blocks(batches, "text", BLOCK_BYTES):
            found, owner, words = features.of(block.column("text").to_pylist())
            n = np.bincount(owner, minlength=len(words))
            weight = np.zeros(len(words), np.int64)
            np.add.at(weight, owner, gain[found])
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in block.column("h").to_pylist()]
            ids, rows = (block.column(c).combine_chunks() for c in ("id", "row"))
            yield pa.RecordBatch.from_arrays(
                [ids, rows, *(pa.array(c, pa.int64()) for c in (words, n, weight, weight + np.array(noise, np.int64)))],
                names=["id", "row", "n_words", "n_features", "weight", "score"],
            )

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    named = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long").alias("h"),
        text_of(text_col).cast("binary").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return named.mapInArrow(score, f"id {kind}, row long, n_words long, n_features long, weight long, score long")


def _order():
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]


def _numbered(df: DataFrame, group: str, name: str) -> DataFrame:
    """Rows with their place, from 0, in the stretch of equal ``group``; the order inside
    partitions is kept, and no group may lie in two partitions."""
    from pyspark.sql.types import LongType, StructField, StructType

    def number(batches):
        import numpy as np
        import pyarrow as pa

        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            base = np.zeros(len(first), np.int64)
            base[0] = n if last is not None and keys[0] == last else 0
            sizes = np.diff(np.append(first, len(keys)))
            place = np.arange(len(keys)) - np.repeat(first - base, sizes)
            last, n = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, name])

    return df.mapInArrow(number, StructType([*df.schema.fields, StructField(name, LongType())]))


def ranked(rows: DataFrame, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """``rows`` (id, row, score, ...) with rank from 1: greatest score first, ties to the
    smaller id, null ids last, then to the smaller row number, which must be unique."""
    local = rows.withColumn("run", F.spark_partition_id().cast("long")).sortWithinPartitions(*_order())
    runs = cut_lineage(_numbered(local, "run", "at"), "runs")
    n = runs.count()
    segments = max(1, min(SEGMENTS, -(-n // rows_per_segment)))
    step = max(1, n // (segments * SAMPLES_PER_SEGMENT))
    samples = runs.filter(F.col("at") % step == step // 2).select("score", "id", "row")
    every = Window.partitionBy()
    placed = samples.select(
        "score", "id", "row",
        F.row_number().over(every.orderBy(*_order())).alias("nth"), F.count("*").over(every).alias("all"),
    )
    part = F.expr(f"(nth * {segments}) div all")
    before = F.expr(f"((nth - 1) * {segments}) div all")
    splitters = placed.filter((part != before) & (F.col("nth") < F.col("all"))).orderBy("nth").select("score", "id", "row").collect()
    bounds = [(-s.score, s.id is None, s.id, s.row) for s in splitters]

    def cut(batches):
        from bisect import bisect_left

        import numpy as np
        import pyarrow as pa

        keys = np.array([b[0] for b in bounds], np.int64)
        for batch in batches:
            key = -batch.column(batch.schema.get_field_index("score")).to_numpy()
            low = np.searchsorted(keys, key)
            tied = np.flatnonzero(low != np.searchsorted(keys, key, side="right"))
            if len(tied):
                few = batch.take(pa.array(tied))
                ids, numbers = (few.column(few.schema.get_field_index(c)).to_pylist() for c in ("id", "row"))
                low[tied] = [
                    bisect_left(bounds, (int(k), i is None, i, r)) for k, i, r in zip(key[tied], ids, numbers)
                ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int32())], names=[*batch.schema.names, "segment"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    pieces = runs.drop("run", "at")
    pieces = pieces.mapInArrow(cut, StructType([*pieces.schema.fields, StructField("segment", IntegerType())]))
    merged = pieces.repartitionById(segments, "segment").sortWithinPartitions("segment", *_order())
    placed = cut_lineage(_numbered(merged, "segment", "inside"), "segments")
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("segment").agg(F.count("*").alias("n")).select(
        "segment", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    # One row per segment, SEGMENTS at most.
    return placed.join(F.broadcast(bases), "segment").select(
        *[c for c in placed.columns if c not in ("segment", "inside")],
        (F.col("base") + F.col("inside") + 1).alias("rank"),
    )


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Of the N documents of at least ``least_words`` words the floor(percent * N / 100) of
    highest score have a rank from 1, ties to the smaller id; all others have none. Null
    texts have no words and weight 0. A null id hashes as the empty string and comes last
    among ties; repeated rows of one id are ranked one after the other. An empty target
    leaves every gain to smoothing; empty ``docs`` give no rows. Other columns are ignored.
    """
    gain = gains(
        bucket_counts(docs, text_col, buckets, most_words), bucket_counts(target, target_text_col, buckets, most_words)
    )
    rows = cut_lineage(scored(docs, gain, id_col, text_col, most_words, seed), "scores")
    eligible = rows.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = ranked(eligible, rows_per_segment)
    out = ["id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = rows.filter(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return order.select(*out, rank.alias("rank")).unionAll(rest).withColumnRenamed("id", id_col)


SQL = f"""
WITH crc_rows AS (
  SELECT range AS n, list_reduce(list_prepend(range, range(8)), lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_rows),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
counted AS (SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(octet_length(encode(word))),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM counted), crc_table),
features AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN vocabulary USING (word) GROUP BY ALL),
sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM sides),
weights AS (
  SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight
  FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible
  FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * eligible // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""


@query(SQL)
def op11_importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their weight, score and, if drawn, rank towards the benchmark's texts."""
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
