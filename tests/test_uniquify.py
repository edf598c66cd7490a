"""Uniquification against an independent sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.operators.ordering import Buckets
from tidemark.operators.uniquify import SLUGS, TITLES, record_numbers, unique_names, unique_titles


def model(names, form, pinned=None):
    seen, out = set(), []
    for i, name in enumerate(names):
        if pinned and pinned[i]:
            final = name
        else:
            final, k = name, form.first
            while final in seen:
                final = f"{name}{form.left}{k}{form.right}"
                k += 1
        seen.add(final)
        out.append(final)
    return out


def run(spark, names, form, buckets, pinned=None):
    rows = [(i, n, bool(pinned and pinned[i])) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "pos long, name string, pinned boolean")
    got = unique_names(
        df, "name", "pos", form, pinned=F.col("pinned") if pinned else None, buckets=buckets
    ).collect()
    return [r.final_name for r in sorted(got, key=lambda r: r.pos)]


def test_hand_cases(spark):
    b = Buckets()
    assert run(spark, ["a", "a", "a-1", "a"], SLUGS, b) == ["a", "a-1", "a-1-1", "a-2"]
    assert run(spark, ["T", "T", "T (2)", "T"], TITLES, b) == ["T", "T (2)", "T (2) (2)", "T (3)"]
    assert run(spark, ["", "", "x"], SLUGS, b) == ["", "-1", "x"]
    assert run(spark, ["a-01", "a", "a", "a-1", "a-1"], SLUGS, b) == ["a-01", "a", "a-1", "a-1-1", "a-1-2"]


@pytest.mark.parametrize("seed", range(6))
def test_random_slugs(spark, seed):
    rng = random.Random(seed)
    names = []
    for _ in range(400):
        name = rng.choice("ab")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            name += f"-{rng.randint(1, rng.choice([3, 12, 60]))}"
        names.append(name)
    buckets = Buckets() if seed % 2 else Buckets(bounds=(37, 111, 200, 290))
    assert run(spark, names, SLUGS, buckets) == model(names, SLUGS)


@pytest.mark.parametrize("seed", range(3))
def test_random_titles_with_pins(spark, seed):
    rng = random.Random(100 + seed)
    names, pinned = [], []
    for _ in range(300):
        name = rng.choice(["T", "U"])
        for _ in range(rng.choice([0, 0, 1, 2])):
            name += f" ({rng.randint(1, 9)})"
        names.append(name)
        pinned.append(rng.random() < 0.1)
    buckets = Buckets(bounds=(50, 150)) if seed else Buckets()
    assert run(spark, names, TITLES, buckets, pinned) == model(names, TITLES, pinned)


def test_many_numbered_originals_of_one_name(spark):
    """One name and its numbered forms, in many orders; chains of bases that lose their names."""
    rng = random.Random(11)
    names = ["item"] * 150 + [f"item-{k}" for k in range(1, 220)] * 2 + [f"item-{k}-1" for k in range(1, 40)]
    names += ["x" + "-1" * k for k in range(5)] * 2
    for order in (lambda n: 0, lambda n: n, lambda n: rng.random()):
        mixed = sorted(names, key=order)
        assert run(spark, mixed, SLUGS, Buckets(width=60)) == model(mixed, SLUGS)


def test_hot_name_is_split(spark):
    df = spark.range(5000).select(F.col("id").alias("pos"), F.lit("same").alias("name"))
    out = unique_names(df, "name", "pos", SLUGS, buckets=Buckets(width=500))
    rows = {r.pos: r.final_name for r in out.collect()}
    assert rows[0] == "same" and all(rows[i] == f"same-{i}" for i in range(1, 5000))


def test_untitled(spark):
    df = spark.createDataFrame(
        [(10, "A"), (20, None), (30, ""), (40, "Untitled Prompt 3"), (50, "A")], "pos long, title string"
    )
    numbered = df.join(record_numbers(df, "pos", Buckets(bounds=(25,))), "pos")
    got = unique_titles(numbered, "title", "pos", "number", Buckets()).collect()
    assert [r.final_name for r in sorted(got, key=lambda r: r.pos)] == [
        "A", "Untitled Prompt 2", "Untitled Prompt 3", "Untitled Prompt 3 (2)", "A (2)",
    ]


def test_measured_buckets_are_balanced(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") * F.col("id")).alias("pos"))
    b = ordering.measure_buckets(df, "pos", rows_per_bucket=100)
    sizes = [r[1] for r in df.groupBy(b.of(F.col("pos"))).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 130


def test_stretches_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CUTS", 4)
    df = spark.range(1000).select((F.col("id") * 3 + 7).alias("pos"))
    b = ordering.measure_buckets(df, "pos", rows_per_bucket=50)
    cells = df.groupBy(b.of(F.col("pos")).alias("cell")).agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = sorted(cells.collect(), key=lambda r: r.cell)
    assert b.parts == 5 and max(r.n for r in rows) <= 60
    assert all(a.hi < c.lo for a, c in zip(rows, rows[1:]))
