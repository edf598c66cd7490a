"""Sketches, streaming counts and published runs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, sketches
from tidemark.sources import publication
from tidemark.streaming import counts, first_seen, ingest

from .records import good, write


def test_merged_sketches_equal_one_pass(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 7).alias("file"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.pmod(F.xxhash64("id"), F.lit(30_000)).cast("string")).alias("value"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("few"),
    )
    columns = {"value": F.col("value"), "few": F.col("few")}
    kept = sketches.distinct_sketches(rows, columns, ["file"])
    merged = sketches.estimated(sketches.merge_sketches(kept, ["value", "few"]), ["value", "few"]).first()
    whole = sketches.estimated(sketches.distinct_sketches(rows, columns), ["value", "few"]).first()
    exact = profile.distinct_counts(rows, columns).first()
    assert merged.few == whole.few == exact.few == 5
    for got in (merged.value, whole.value):
        assert abs(got / exact.value - 1) < 4 * sketches.distinct_error()
    assert abs(merged.value / whole.value - 1) < sketches.distinct_error() / 10
    size = kept.selectExpr("max(length(value))").first()[0]
    assert size <= 2**sketches.LG_K + 100
    none = sketches.estimated(sketches.distinct_sketches(rows.limit(0), columns), ["value"]).first()
    assert none.value == 0


@pytest.mark.parametrize("tracked", [4, 64, 1000])
def test_top_distribution_is_exact(spark, tracked):
    """With few counters most groups aren't decided by the sketch."""
    rng = random.Random(3)
    rows = [("a", f"v{min(int(rng.expovariate(0.2)), 60)}") for _ in range(3000)]
    rows += [("flat", f"u{i % 400}") for i in range(1200)] + [(None, "x"), (None, "y"), (None, "x"), ("one", "z"), ("none", ""), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v string")
    got = sketches.top_distribution(df, "g", {"v": F.col("v"), "w": F.length("v")}, 5, tracked).collect()
    want = []
    for facet, of in (("v", lambda v: v), ("w", lambda v: None if v is None else str(len(v)))):
        for g in {g for g, _ in rows}:
            seen = Counter(x for h, v in rows if h == g for x in [of(v)] if x)
            top = sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:5]
            want += [(g, facet, v, n, i + 1, sum(seen.values())) for i, (v, n) in enumerate(top)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_of_batches_are_exactly_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    files = {f"{i:02d}.jsonl": [good(3 * i + j, difficulty="expert" if j else "beginner") for j in range(3)] + ["{bad"] * (i % 2) for i in range(5)}

    def arrive(names, fold_every=2):
        write(folder, {n: files[n] for n in names})
        lines = ingest.arriving_lines(spark, str(folder))
        sink = counts.counted_sink(lines, counts.record_counts, out, str(tmp_path / "state"), fold_every)
        sink.trigger(availableNow=True).start().awaitTermination()

    def now():
        return {(r.facet, r.value): r.n for r in counts.read_counts(spark, out).collect()}

    def expected(k):
        want = {("category", "ui_components"): 3 * k, ("language", "en"): 3 * k, ("difficulty", "expert"): 2 * k, ("difficulty", "beginner"): k}
        for i in range(k):
            name = f"{i:02d}.jsonl"
            want |= {("lines", name): 3 + i % 2, ("valid", name): 3} | ({("invalid", name): 1} if i % 2 else {})
        return want

    with pytest.raises(FileNotFoundError):
        counts.read_counts(spark, out)
    for i in range(5):
        arrive([f"{i:02d}.jsonl"])
        assert now() == expected(i + 1)
    assert publication.listed(spark, f"{out}/folded") == [1, 3]
    assert publication.listed(spark, f"{out}/batches") == [2, 3, 4]
    # A fold that is done again, and one that was cut off, change nothing.
    counts.fold(spark, out, 3)
    assert now() == expected(5)
    (tmp_path / "out" / "folded" / "4").mkdir()
    assert now() == expected(5)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    write(tmp_path / "in", {"a.jsonl": [good(1), good(2)]})
    for _ in range(2):  # a lost checkpoint replays batch 0
        lines = ingest.arriving_lines(spark, str(tmp_path / "in"))
        state = str(tmp_path / f"state{random.random()}")
        counts.counted_sink(lines, counts.record_counts, out, state).trigger(availableNow=True).start().awaitTermination()
    assert {(r.facet, r.n) for r in counts.read_counts(spark, out).collect()} == {
        (f, 2) for f in ("category", "difficulty", "language", "lines", "valid")
    }


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    target = str(tmp_path / "site")
    with pytest.raises(FileNotFoundError):
        publication.current(spark, target)

    def job(n, fail=False):
        def run(folder):
            spark.range(n).write.parquet(f"{folder}/one")
            if fail:
                raise RuntimeError("killed between two writes")
            spark.range(n).write.parquet(f"{folder}/two")

        return run

    def rows():
        now = publication.current(spark, target)
        return [spark.read.parquet(f"{now}/{t}").count() for t in ("one", "two")]

    publication.publish(spark, target, job(3))
    assert rows() == [3, 3]
    with pytest.raises(RuntimeError):
        publication.publish(spark, target, job(5, fail=True))
    assert rows() == [3, 3]
    # A claim without a record is a gap.
    (tmp_path / "site" / "_published" / "claim-000000000002").touch()
    publication.publish(spark, target, job(7))
    assert rows() == [7, 7] and sorted(publication.records(spark, target)) == [1, 3]
    publication.publish(spark, target, job(8))
    publication.prune(spark, target, keep=1)
    assert rows() == [8, 8] and len(list((tmp_path / "site" / "runs").iterdir())) == 1


@pytest.mark.parametrize("keep", [None, 1])
def test_first_seen_over_batches(spark, tmp_path, keep):
    batches = [
        [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c"), (6, None)],
        [(7, "a"), (8, "d"), (9, "d"), (10, "d"), (11, None)],
        [(12, "b"), (13, "e"), (14, "d"), (15, "a"), (16, "a")],
    ]
    schema, out = "order long, key string", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for state in ("state", "again") if keep is None and i == 0 else ("state",):  # "again" replays batch 0
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            stream = stream.withColumn("place", F.concat(F.lit("row:"), "order"))
            sink = first_seen.first_seen_sink(stream, out, str(tmp_path / state), keep)
            sink.trigger(availableNow=True).start().awaitTermination()
    want, first = set(), {}
    for i, rows in enumerate(batches):
        if keep is not None:
            first = {k: p for k, p in first.items() if p[0] >= i - keep}
        for n, key in rows:
            if key in first:
                want.add((n, key, f"row:{first[key][1]}"))
            elif key is not None:
                first[key] = (i, n)
    assert {(r.order, r.key, r.seen_at) for r in first_seen.read_repeats(spark, out).collect()} == want
