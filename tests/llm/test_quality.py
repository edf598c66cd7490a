"""Quality model: held-out accuracy, label hygiene and degenerate input."""

import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def corpus(n=900):
    rng = random.Random(8)
    words = "the of and river stone cloud window paper garden music winter table".split()
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if not good:
            kind = rng.randrange(3)
            text = [[w.upper() + "!!", w + rng.choice(["%%%", "###"]), text[0]][kind] for w in text]
        docs.append((i, " ".join(text), "en", 1.0))
        labels.append((i, int(good), 0))
    docs += [(None, "the river", "en", 1.0), (5000, None, "en", 1.0), (5001, "", "en", 1.0), (5002, "  \n", "en", 1.0)]
    docs += [(5003, "word " * 50000, "en", 1.0), (5004, "the river", "en", 1.0), (5004, "the river", "en", 1.0)]
    labels += [(3, None, 0), (4, 7, 0), (None, 1, 0), (77777, 1, 0), (5, labels[5][1], 0)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    out = quality.score(d, quality.fit(d, lab, bits=14))
    assert out.columns == ["doc_id", "text", "lang", "score"]
    rows = out.withColumn("out", quality.held_out("doc_id")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: q for i, q, _ in labels[:900]}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [(r.score >= 0.3, truth[r.doc_id] == 1) for r in rows if r.out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert all(a for a, b in held if b)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(300)
    turned = [(i, q if i is None or q is None or zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (quality.fit(d, spark.createDataFrame(x, LABELS), bits=12) for x in (labels, turned))
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_other_columns_are_no_input(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, DOCS)
    model = quality.fit(d, spark.createDataFrame(labels, LABELS), bits=12)
    other = d.withColumn("doc_id", F.lit(1).cast("long")).withColumn("lang", F.lit("xx"))
    assert sorted(r.score for r in quality.score(d, model).collect()) == sorted(r.score for r in quality.score(other, model).collect())


def test_one_class_none_and_no_documents(spark):
    docs, labels = corpus(60)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    for some in (lab.filter("quality = 1"), lab.limit(0)):
        scores = {r.score for r in quality.score(d, quality.fit(d, some, bits=10)).collect()}
        assert len(scores) == 1
    assert quality.score(d.limit(0), quality.fit(d.limit(0), lab, bits=10)).collect() == []


def test_features_are_the_distinct_runs():
    one = quality.Features(16)
    for text in ("", "a", "a b", "a b a b", "A1!! b2", "a a a a"):
        together, cuts = one.of(["x y z", text, "p q"])
        alone, _ = one.of([text])
        assert together[cuts[1] : cuts[2]].tolist() == alone.tolist() == sorted(set(alone.tolist()))


def plain_dual(x, y, cost, steps=60_000):
    """Projected gradient on the dual of the hinge loss, with a constant last feature."""
    x = np.hstack([x, np.ones((len(x), 1))]) * y[:, None]
    gram = x @ x.T
    rate, a = 1 / np.linalg.eigvalsh(gram)[-1], np.zeros(len(x))
    for _ in range(steps):
        a = np.clip(a - rate * (gram @ a - 1), 0, cost)
    return x.T @ a, a


def test_hinge_fit_is_the_optimum():
    rng = np.random.RandomState(5)
    for cost in (0.1, 1.0):
        x = rng.standard_normal((40, 6)) * (rng.rand(40, 6) < 0.6)
        y = np.where(x @ rng.standard_normal(6) + 0.7 * rng.standard_normal(40) > 0.2, 1.0, -1.0)
        limits = np.where(y > 0, cost, 2 * cost)
        rows = [np.flatnonzero(r) for r in x]
        got = quality.hinge_fit(rows, [r[i] for r, i in zip(x, rows)], y, 6, limits, epochs=20_000)
        want, _ = plain_dual(x, y, limits)

        def loss(w):
            return 0.5 * w @ w + (limits * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()

        assert loss(got) <= loss(want) * 1.005 + 1e-6 and np.abs(got - want).max() < 0.05


def test_class_counts_and_ratios(spark):
    """Counts of all labelled rows against sets of each text, and the weights made of them."""
    docs, labels = corpus(200)
    docs, labels = docs[:200], labels[:200]
    bits, one = 12, quality.Features(12)
    grams = {i: one.of([t])[0] for i, t, *_ in docs}
    used = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    counts, sizes = np.zeros((2, 1 << bits)), [0, 0]
    for i, q in used:
        counts[q][grams[i]] += 1
        sizes[q] += 1
    rows = spark.createDataFrame([(dict((i, t) for i, t, *_ in docs)[i], q) for i, q in used], "text string, label int").repartition(3)
    got, got_sizes = quality.class_counts(rows, bits)
    assert (got == counts).all() and list(got_sizes) == sizes
    share = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    used.sort()
    sign = np.array([2.0 * q - 1 for _, q in used])
    cost = np.where(sign > 0, 1.0, max(1.0, sizes[1] / sizes[0]))
    own = [grams[i] for i, _ in used]
    weights = quality.hinge_fit(own, [ratio[g] / np.sqrt(len(g)) for g in own], sign, 1 << bits, cost)
    model = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), bits=bits)
    assert np.allclose(model.weights, weights[:-1] * ratio, atol=1e-5) and abs(model.bias - weights[-1]) < 1e-9


def test_fit_holds_the_sample_once(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    tracemalloc.start()
    model = quality.fit(d, lab)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    grams = sum(len(quality.Features().of([t])[0]) for i, t in docs if zlib.crc32(str(i).encode()) % 5)
    # The sample and a dozen arrays of 2**18; the sample's values would take 8 bytes an n-gram more.
    assert model.weights.any() and most < 4 * grams + 12 * 8 * 2**18
    x = quality.Scaled([np.array([1, 3]), np.array([], np.int32)], np.arange(4.0))
    assert [v.tolist() for v in x] == [[1 / np.sqrt(2), 3 / np.sqrt(2)], []]
