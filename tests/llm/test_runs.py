"""Runs of words against the definition, and transforms against plain correlation."""

import hashlib
import random
from fractions import Fraction

import numpy as np

from tidemark.llm import runs as R
from tidemark.llm.runs import Finder, Transform, looped, op12_periodic_runs, periodic_runs


def brute(words, least=24, periods=3):
    out = []
    n = len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                stretch = words[i : j + q]
                smaller = any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q))
                if len(stretch) >= max(least, periods * q) and not smaller:
                    out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out)


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(9)
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 25, ["a", "b"] * 300, ["b"] + ["a"] * 500 + ["b"] * 30]
    for alphabet in (1, 2, 3, 50):
        for _ in range(12):
            words = []
            while len(words) < rng.choice([30, 120, 400]):
                part = [f"w{rng.randrange(alphabet)}" for _ in range(rng.choice([1, 2, 5, 9, 17, 33, 60]))]
                words += (part * rng.randint(1, 9))[: rng.randint(1, 300)]
                if rng.random() < 0.3:
                    words[rng.randrange(len(words))] = "odd"
            out.append(words)
    for q in (7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 65, 127, 128):
        part = [f"p{i}" for i in range(q)]
        for extra in (0, 1, q // 2):
            out.append([f"x{i}" for i in range(rng.randrange(20))] + part * 3 + part[:extra] + ["end"])
        out.append((part * 3)[:-1])
    inner = [f"i{k}" for k in range(9)]
    out.append((inner * 4 + [f"o{k}" for k in range(20)]) * 4)  # runs inside the copies of a run
    return out


def numbered(lists):
    numbers = {}
    flat = np.array([numbers.setdefault(w, len(numbers) + 1) for t in lists for w in t], np.int64)
    return flat, np.array([len(t) for t in lists], np.int64)


def test_runs_equal_definition_one_by_one_and_end_to_end():
    lists = texts()
    finder = Finder()
    for t in lists:
        assert finder.runs(*numbered([t])) == brute(t), t
    begins = np.cumsum([0, *map(len, lists)])
    want = sorted((int(b) + s, n, q) for b, t in zip(begins, lists) for s, n, q in brute(t))
    assert finder.runs(*numbered(lists)) == want
    assert len(want) > 60


def test_transform_is_exact_correlation():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, R.PRIME, (3, 64)), rng.integers(0, R.PRIME, (3, 64))
    t = Transform()
    assert (t.backward(t.forward(a)) == a).all()
    got = t.backward(t.forward(a) * t.forward(b) % R.PRIME)
    for row in range(3):
        for k in (0, 1, 40, 63):
            assert got[row, k] == sum(int(a[row, i]) * int(b[row, (k - i) % 64]) for i in range(64)) % R.PRIME


def test_sums_that_vanish_only_modulo_the_prime():
    """Two values whose squared difference is a multiple of the prime can't be told apart by sums."""
    words = np.array([1, R.PRIME + 1] * 40, np.int64)
    assert Finder().runs(words, np.array([80])) == [(0, 80, 2)]


def test_long_texts_with_one_and_with_huge_periods():
    part = list(range(1, 20_001))
    words = np.array(part * 3 + [1], np.int64)
    assert Finder().runs(words, np.array([len(words)])) == [(0, 60_001, 20_000)]
    assert Finder().runs(np.ones(300_000, np.int64), np.array([300_000])) == [(0, 300_000, 1)]


def test_rows(spark):
    lists = texts()[:30]
    rows = [(i, " \n".join(t), "n") for i, t in enumerate(lists)] + [(None, "a " * 24, "x"), (5, None, "x"), (5, "", "x"), (6, " a b é " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4)
    got = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs)), r.n_words) for r in periodic_runs(docs).collect()}
    want = set()
    for i, t, _ in rows:
        words = (t or "").encode().split()
        found = brute(words)
        want.add((i, " ".join(w.decode() for w in words) if not found else collapse([w.decode() for w in words], found), tuple(found), len(words)))
    assert got == want
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_definition(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 30, 90, 200])))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    several = 0
    for i, t in rows:
        words = looped(i, t.split())
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert got[i] == (i, len(found), *numbers, sha(lines), sha(collapse(words, found)))
        several += len(found) > 0
    assert several > 5
