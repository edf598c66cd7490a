"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tidemark.llm.importance import Features, bucket_counts, gains, ranked, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most=1):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, buckets=10_000, most=1, least=20, percent=10, seed="2024"):
    s = Counter(bucket(f, buckets) for _, t in docs for f in features(t, most)[1])
    g = Counter(bucket(f, buckets) for t in target for f in features(t, most)[1])
    all_s, all_g = sum(s.values()), sum(g.values())
    rows = []
    for k, (i, t) in enumerate(docs):
        words, fs = features(t, most)
        weight = 0
        for f in fs:
            b = bucket(f, buckets)
            weight += math.floor(1000 * math.log((g[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_g + buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, len(words)])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    ranks = {id(r): n for n, r in enumerate(drawn, 1)}
    return sorted(((r[0], r[1], r[2], r[3], ranks.get(id(r))) for r in rows), key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = ["The", "ÄPFEL", "z3", "naïve", "don't", "日本", "a_b", "x" * 70, "Über-all"] + [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 19, 20, 21, 60, 300])))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "  \n"), (903, "y" * 200_000), (904, "long " * 50_000)]
    docs += [(7, "twin words " * 15)] * 40 + [(None, "no id " * 20)] * 3
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(50)) for _ in range(20)] + [None, ""]
    return docs, target


def test_equals_plain_computation(spark):
    docs, target = corpus()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"buckets": 97, "most_words": 3, "percent": 55}):
        want = brute(docs, target, options.get("buckets", 10_000), options.get("most_words", 1), percent=options.get("percent", 10))
        for per_segment in (7, 10_000):
            got = resampled(table, aim, rows_per_segment=per_segment, **options)
            assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
            assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_ranks_with_one_score_everywhere(spark):
    rows = spark.range(3000).selectExpr("if(id % 5 = 0, null, string(id % 700)) AS id", "id AS row", "if(id % 3 = 0, id, 5L) AS score")
    got = ranked(rows.repartition(6), rows_per_segment=100).collect()
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.id is None, r.id or "", r.row))
    assert [r.row for r in sorted(got, key=lambda r: r.rank)] == [r.row for r in want]
    assert sorted(r.rank for r in got) == list(range(1, 3001))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "w " * 30)], "doc_id long, text string")
    assert resampled(none, some).collect() == []
    assert [r[:3] for r in resampled(some, none, percent=100).collect()] == [(1, 30, brute([(1, "w " * 30)], [])[0][2])]


def test_counts_and_gains(spark):
    texts = ["a b a", None, "B"]
    n = bucket_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 50)
    assert n[bucket("a", 50)] == 2 and n[bucket("b", 50)] == 2 and n.sum() == 4
    assert (gains(n, n) == 0).all()
    assert Features(50).of([])[2].tolist() == []
