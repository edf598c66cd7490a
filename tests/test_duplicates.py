"""Groups, members and windowed pairs against brute force."""

import random

from pyspark.sql import functions as F

from tidemark.operators import dups, ordering
from tidemark.operators.nearpairs import near_pairs
from tidemark.operators.ordering import Buckets
from tidemark.spec import RecordSpec

SPEC = RecordSpec(id="id", pos="pos", text="text", category="cat")
UNIQUE = RecordSpec(id="id", pos="pos", text="text", category="cat", unique_ids=True)


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos long, id string, cat string, text string")


def brute(rows, window=49):
    by_cat = {}
    for pos, id, cat, txt in sorted(rows):
        by_cat.setdefault(cat, []).append((id, set(txt.lower().split())))
    out = set()
    for cat, items in by_cat.items():
        seen = set()
        for i, (a, x) in enumerate(items):
            for b, y in items[i + 1 : i + 1 + window]:
                key = tuple(sorted((a, b)))
                if key in seen:
                    continue
                seen.add(key)
                if x and y and len(x & y) * 10 > len(x | y) * 7:
                    out.add((cat, a, b, len(x & y), len(x | y)))
    return out


def pairs(df, spec, buckets):
    got = near_pairs(df, spec, buckets=buckets).collect()
    out = {(r.category, r.id1, r.id2, r.shared, r.total) for r in got}
    assert len(out) == len(got)
    return out


def texts(rng, n):
    base = [f"w{i}" for i in range(14)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            words[rng.randrange(14)] = f"v{rng.randrange(40)}"
        yield " ".join(words) if rng.random() > 0.05 else ""


def test_pairs_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, f"r{i}", rng.choice("xxxy"), t) for i, t in enumerate(texts(rng, 260))]
    want = brute(rows)
    assert len(want) > 300
    df = frame(spark, rows)
    assert pairs(df, UNIQUE, Buckets()) == want
    assert pairs(df, UNIQUE, Buckets(bounds=(100, 333, 500))) == want


def test_repeated_ids_count_once(spark):
    rng = random.Random(2)
    rows = [(i, f"r{rng.randrange(60)}", "x", t) for i, t in enumerate(texts(rng, 160))]
    assert pairs(frame(spark, rows), SPEC, Buckets(width=50)) == brute(rows)


def test_window_edges(spark):
    rows = [(i, f"r{i:02d}", "x", "same words here") for i in range(51)]
    rows += [(100 + i, f"s{i}", f"c{i}", "same words here") for i in range(2)]
    got = pairs(frame(spark, rows), UNIQUE, Buckets())
    assert len(got) == 1274
    assert ("x", "r00", "r49", 3, 3) in got and ("x", "r00", "r50", 3, 3) not in got


def test_threshold_is_strict(spark):
    ten = [f"w{i}" for i in range(10)]
    rows = [(0, "a", "x", " ".join(ten)), (1, "b", "x", " ".join(ten[:7])), (2, "c", "y", " ".join(ten[:8])), (3, "d", "y", " ".join(ten[:6]))]
    assert pairs(frame(spark, rows), UNIQUE, Buckets()) == {("y", "c", "d", 6, 8)}


def test_groups_members_heads(spark):
    rows = dups.keyed(
        spark.range(60).select("id", F.when(F.col("id") < 40, "hot").when(F.col("id") < 44, None).otherwise(F.col("id").cast("string")).alias("k")),
        F.col("k"), "id", "id",
    )
    groups = {r.key: (r.n, r.first_pos) for r in dups.groups(rows).collect()}
    assert groups == {"hot": (40, 0), "": (4, 40)}
    heads = {r.key: r.ids for r in dups.group_heads(rows, 3).collect()}
    assert heads == {"hot": [0, 1, 2], "": [40, 41, 42]}
    assert {r.pos for r in dups.later_occurrences(rows).collect()} == set(range(1, 40)) | {41, 42, 43}


def test_hot_keys_are_salted(spark):
    rows = spark.range(300).select(F.col("id").alias("pos"), F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = ordering.join_per_key(rows, per_key, "key", "pos", hot_rows=50, salts=8)
    assert joined.count() == 300 and joined.filter("n = 200").count() == 200


def test_openings(spark):
    df = spark.createDataFrame([("A b c d e f",)] * 5 + [("x y z 1 2 3",)] * 6, "t string")
    assert [tuple(r) for r in dups.overused_openings(df, "t").collect()] == [("x y z 1 2", 6)]


def test_running_sum_in_cells(spark):
    df = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).cast("string").alias("g"), F.lit(2).alias("w"))
    for b in (Buckets(), Buckets(width=300), Buckets(bounds=(5, 600, 1900))):
        got = ordering.running_sum(df, ["g"], "pos", "s", b, F.col("w")).collect()
        for r in got:
            want = 2 * (r.pos // 3 + 1) if r.g == "true" else 2 * (r.pos - r.pos // 3)
            assert r.s == want


def test_report_names_all_members_of_large_groups(spark):
    from tidemark.plans.dedupe import report_members

    df = spark.range(2600).selectExpr("id AS pos", "concat('r', id) AS id", "CASE WHEN id % 2 = 0 THEN 'a' WHEN id < 9 THEN 'b' ELSE concat('c', id) END AS k")
    got = report_members(dups.keyed(df, F.col("k"), "pos", "id"), Buckets(), 1).orderBy("nth").collect()
    assert [(r.key, r.nth, r.id) for r in got] == [("a", i + 1, f"r{2 * i}") for i in range(1300)]
    every = report_members(dups.keyed(df, F.col("k"), "pos", "id"), Buckets()).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in every} == {"a": 1300, "b": 4}


def test_report_lists_every_id_of_large_groups(spark):
    from tidemark.plans import dedupe
    from tidemark.spec import RECORDS

    rows = spark.range(1700).selectExpr(
        "id AS pos", "concat('P', id) AS id", "if(id < 1500, 'same', concat('t', id)) AS title", "concat('s', id) AS slug",
        "concat('word', id) AS prompt", "'c' AS category")
    found = dedupe.analyse(rows, RECORDS, Buckets(width=97)).report_ids()
    titles = sorted((r.title, r.occurrences, r.nth, r.id) for r in found["titles"].collect())
    assert titles == sorted(("same", 1500, k + 1, f"P{k}") for k in range(1500))
    # Digits don't count towards fingerprints, so all texts are one group.
    assert sorted(r.nth for r in found["fingerprints"].collect()) == list(range(1, 1701))
    assert found["slugs"].count() == 0


def test_members_of_salted_keys(spark):
    rows = spark.range(3000).selectExpr("id AS pos", "id", "if(id % 3 = 0, 'hot', string(id % 50)) AS key")
    sizes = {r.key: r[1] for r in rows.groupBy("key").count().collect()}
    got = dups.members(rows, hot_rows=2).collect()
    assert sorted(r.pos for r in got) == list(range(3000))
    assert all(r.n == sizes[r.key] for r in got)
