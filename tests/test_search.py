"""Sorting, paging and dimension cases on small frames."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, index as idx, profile, rules, search


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"id{i}", t, q) for i, (t, q) in enumerate([("b", 5), ("A", None), ("a", 7), ("ä", 7), ("Z", 0)])]
    return spark.createDataFrame(rows, "pos long, id string, t string, q int")


def titles(df):
    return [r.t for r in df.collect()]


def test_sorts(index):
    assert titles(search.page(index)) == ["b", "A", "a", "ä", "Z"]
    assert titles(search.page(index, "quality")) == ["a", "ä", "b", "A", "Z"]
    assert titles(search.page(index, "az")) == ["a", "A", "ä", "b", "Z"]
    with pytest.raises(ValueError):
        search.page(index, "newest")


def test_pages_and_continuation(spark, index):
    many = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("q"), F.col("id").cast("string").alias("t"))
    assert [r.pos for r in search.page(many, number=1).collect()] == list(range(48, 96))
    assert [r.pos for r in search.page(many, number=2).collect()] == list(range(96, 100))
    for sort, key in (("relevance", lambda r: (r.pos,)), ("quality", lambda r: (r.q, r.pos)), ("az", lambda r: (r.t, r.pos))):
        whole = [r.pos for r in search.page(many, sort, size=100).collect()]
        first = search.page(many, sort, size=40).collect()
        rest = [r.pos for r in search.page(many, sort, size=100, after=key(first[-1])).collect()]
        assert [r.pos for r in first] + rest == whole


def test_page_is_a_top_k(index):
    plan = search.page(index, "quality")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_facets_reach_the_scan(spark, index, tmp_path):
    index.write.parquet(str(tmp_path / "i"))
    rows = search.matching(spark.read.parquet(str(tmp_path / "i")), search.Query(filters={"x": "b"}), {"x": "t"})
    assert "EqualTo(t,b)" in rows._jdf.queryExecution().executedPlan().toString()


def test_top_values_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["c", "b", "c", "a", "b", "a", "c", ""])], "pos long, v string")
    counts = profile.facet_counts(df, {"v": F.col("v")}, "pos")
    got = [(r.value, r.n) for r in profile.top_values(counts, {"v": 2}).orderBy("rank").collect()]
    assert got == [("c", 3), ("b", 2)]


def test_unknown_keys_fall_back(spark):
    df = spark.createDataFrame([("ecommerce",), ("zzz",)], "c string")
    got = [r.label for r in idx.with_label(df, "c", idx.category_dimension(spark), "label", "Landing Pages").collect()]
    assert sorted(got) == ["E-Commerce", "Landing Pages"]
    plain = [r.label for r in idx.with_label(df, "c", idx.category_dimension(spark), "label", None).collect()]
    assert sorted(plain) == ["E-Commerce", "zzz"]


def test_shares_of_missing_levels(spark):
    counts = spark.createDataFrame([("beginner", 1), ("expert", 3), ("other", 4)], "key string, n long")
    got = {r.key: (r.n, r.share) for r in profile.ordered_shares(counts, idx.difficulty_dimension(spark)).collect()}
    assert got == {"beginner": (1, 0.125), "intermediate": (0, 0.0), "advanced": (0, 0.0), "expert": (3, 0.375)}


def test_split_and_status(spark):
    rows, broken = spark.range(5).toDF("k"), spark.createDataFrame([(1,), (1,), (3,)], "k long")
    ok, bad = rules.split_valid(rows, broken, ["k"])
    assert sorted(r.k for r in ok.collect()) == [0, 2, 4] and sorted(r.k for r in bad.collect()) == [1, 3]
    none = spark.range(0).select(F.col("id").alias("key"))
    one = spark.range(1).select(F.col("id").alias("key"))
    clean = gates.duplicate_status({"fingerprint": none, "title": none, "pairs": none}).first()
    some = gates.duplicate_status({"fingerprint": none, "title": none, "pairs": one}).first()
    assert (clean.overall_status, clean.key_status) == ("CLEAN", "PASS")
    assert (some.overall_status, some.key_status) == ("NEEDS_REVIEW", "PASS")


def test_profile_record_shape(spark):
    row = {
        "category": "c", "subcategory": "s", "difficulty": "expert", "language": "en", "audience": "x", "industry": "",
        "style": ("v", "l", "m"), "quality": (8, 7, 9, 10), "tech_stack": ("React", "GSAP", "CSS"),
    }
    df = spark.createDataFrame(
        [tuple(row.values())],
        "category string, subcategory string, difficulty string, language string, audience string, industry string, "
        "style struct<visual_style string, layout_style string, motion_style string>, "
        "quality struct<specificity_score int, originality_score int, implementation_clarity_score int, website_readiness_score int>, "
        "tech_stack struct<framework string, animation string, styling string>",
    )
    got = profile.record_profile(df).first()
    assert got.n == 1 and got.difficulty_distribution == {"expert": 1} and got.unique_industries == 0
    assert (got.unique_layout_styles, got.avg_website_readiness_score) == (1, 10.0)
