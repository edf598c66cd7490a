"""Vector operators against brute force, with degenerate rows."""

import numpy as np

from tidemark.llm import components as components_module
from tidemark.llm.components import components
from tidemark.llm.groups import blocks_of
from tidemark.llm.near_vectors import link_vectors, shape_for
from tidemark.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, node long, digest string"


def rows_of(n=400, dims=12):
    rng = np.random.RandomState(1)
    centers = rng.standard_normal((6, dims))
    rows = []
    for i in range(n):
        v = centers[i % 6] + rng.standard_normal(dims) * (0.03 if i % 4 == 0 else 0.5)
        rows.append((i * 3, [float(x) for x in v.astype("f4")], None if i % 37 == 0 else i % 3, i, "x"))
    rows += [(10_000 + i, rows[8][1], rows[8][2], 1, "x") for i in range(60)]
    bad = [None, [], [0.0] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")], [None] + [1.0] * (dims - 1)]
    rows += [(20_000 + i, b, 1, 1, "x") for i, b in enumerate(bad)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_equal_all_pairs(spark):
    rows = rows_of()
    for block in (8, 512):
        got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
        use = [r for r in rows if good(r[1]) and r[2] is not None]
        x = np.array([r[1] for r in use])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([r[2] for r in use])
        near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
        np.fill_diagonal(near, False)
        ids = np.array([r[0] for r in use])
        root = ids.copy()
        for _ in range(len(ids)):
            new = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
            if (new == root).all():
                break
            root = new
        want = {r[0]: (0, r[0]) for r in rows} | {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), root)}
        assert got == want


def test_links_of_nothing(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = np.random.RandomState(3)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 400, (260, 2))]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (9000, 9000)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in root}
    assert len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_component_queries_are_few_and_short(spark, monkeypatch):
    plans, cut = [], components_module.cut_lineage

    def noted(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut(df, *args, **options)

    monkeypatch.setattr(components_module, "cut_lineage", noted)
    stars = [(100 * i + k, 100 * i) for i in range(20) for k in range(30)]
    got = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == set(stars) and len(plans) == 1
    chain = [(i, i + 1) for i in range(40)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(41)}
    assert len(plans) > 2 and max(plans) <= 4


def test_nearest_equals_brute_force(spark):
    rows = rows_of()
    got = nearest(spark.createDataFrame(rows, SCHEMA), lambda c: c % 20 == 0, k=5).collect()
    use = [r for r in rows if good(r[1]) and len(r[1]) == 12]
    ids, x = np.array([r[0] for r in use]), np.array([r[1] for r in use], float)
    hits = total = 0
    for q in range(len(use)):
        if ids[q] % 20:
            continue
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        own = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 6))
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(s[at[r.vec_id]] - r.score) < 1e-12 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and ids[q] not in {r.vec_id for r in own}
        hits += len({r.vec_id for r in own} & {int(ids[i]) for i in order})
        total += 5
    assert hits >= 0.98 * total and len(got) == total


def test_nearest_with_few_rows(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), lambda c: c % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, "x")], SCHEMA)
    assert nearest(one, lambda c: c % 20 == 0).collect() == []
    three = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, "x"), (1, [1.0, 2.0], 1, 1, "x"), (2, [3.0, 1.0], 1, 1, "x")], SCHEMA)
    got = sorted(tuple(r) for r in nearest(three, lambda c: c % 20 == 0).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0)]


def test_nearest_with_very_different_norms(spark):
    rng = np.random.RandomState(4)
    x = rng.standard_normal((600, 12))
    x[[3, 50, 120, 333]] *= 1e8
    x[400:420] *= 1e-6
    x = x.astype("f4")
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), lambda c: c % 20 == 0).collect()
    x = x.astype(float)
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = {r.vec_id: r.score for r in got if r.query_id == q}
        assert len(own) == 20 and all(abs(s[i] - v) <= 1e-9 * np.abs(x[i] * x[q]).sum() for i, v in own.items())
        hits += len(set(own) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.97 * 600


def test_blocks_of_a_stream():
    import pyarrow as pa

    rng = np.random.RandomState(4)
    keys = np.sort(rng.randint(0, 6, 500))
    for step in (1, 7, 64, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(np.arange(a, min(a + step, 500)))], names=["k", "n"]) for a in range(0, 500, step)]
        sizes, seen = {}, []
        for table in blocks_of([batches[0].slice(0, 0), *batches], "k", 16):
            own = set(table.column("k").to_pylist())
            assert len(own) == 1 and table.num_rows < step + 32
            sizes.setdefault(own.pop(), []).append(table.num_rows)
            seen += table.column("n").to_pylist()
        assert seen == list(range(500))
        assert all(n % 16 == 0 for v in sizes.values() for n in v[:-1])
    assert list(blocks_of([], "k", 16)) == []


def test_codes_grow_with_the_nodes():
    assert shape_for(0) == shape_for(51_282) == (24, 14)
    p = 1 - np.arccos(0.98) / np.pi
    for n in (10**6, 10**9, 10**12):
        tables, bits = shape_for(n)
        assert n / 2**bits <= 4096 * 2 and (1 - p**bits) ** tables <= 1e-5 and tables <= 300


def test_components_whose_squares_do_not_fit(spark):
    rng = np.random.RandomState(6)
    rows = []
    for i in range(120):
        v = rng.standard_normal(6) + 4 * (np.arange(6) == i % 6)
        rows.append((i, [float(x) for x in v * (1e200, 1e-200, 1.0)[i % 3]], i % 2))
    rows += [(1000 + i, [3 * x for x in rows[i][1]], rows[i][2]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in link_vectors(df).collect()}
    assert got == {r[0]: int(n) for r, n in zip(rows, near.sum(1))} and near.any()
    # All of one size, small enough for products to fit: scores are those of brute force.
    small = [(i, [x * 1e-150 for x in v], k) for i, v, k in rows if i % 3 == 2 and i < 1000]
    found = nearest(spark.createDataFrame(small, df.schema), lambda c: c % 20 == 0, k=5).collect()
    whole = {i: np.array(v) for i, v, _ in small}
    for q in {r.query_id for r in found}:
        best = sorted((-float(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [i for _, i in best]
    assert len(found) == 5 * len([i for i in whole if i % 20 == 0])
