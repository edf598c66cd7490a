"""Near groups against all pairs, with degenerate rows."""

import random
from collections import Counter

from tidemark.llm import bag_minhash
from tidemark.llm.bag_minhash import near_groups, one_of_each_group


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def brute(rows, least):
    """Smallest id of each row's class, from all pairs of distinct texts."""
    texts = list({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= least:
                root[find(i)] = find(j)
    smallest = {}
    for i, t in rows:
        r = find(texts.index(t or ""))
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return sorted((i, smallest.get(find(texts.index(t or "")))) for i, t in rows if i is not None)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, nid = [], 0
    common = [rng.choice(words) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        if rng.random() < 0.5:
            base = common + base
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((nid, " ".join(copy)))
            nid += rng.randint(1, 3)
    line = "same line again and again here\n"
    rows += [(nid + k, line * n) for k, n in enumerate((40, 45, 60, 100, 110))]
    rows += [(9000, ""), (9001, ""), (9002, None), (9003, "  \n"), (9004, "one two"), (9005, "one  two"), (9006, "one two three")]
    rows += [(9000, ""), (9100, "one two"), (None, "one two three"), (9007, "x " * 30000), (9008, "x " * 30500)]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "extra", 3) for i, t in rows], "doc_id long, text string, uid string, size int")
    got = near_groups(docs).select("doc_id", "class_id").collect()
    want = brute(rows, 0.8)
    got = sorted(tuple(r) for r in got if r.doc_id is not None)
    # Texts that differ in white space only have equal bags and are linked, so compare as is.
    assert got == want


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_unlinked_in_one_bucket(spark):
    """Texts that share two thirds of their words meet in buckets without being linked."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(common + [f"r{rng.randrange(10**6)}" for _ in range(45)])) for i in range(60)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 0.8)


def test_small_blocks_and_chunks(spark, monkeypatch):
    """The same classes when every bucket takes many cells and every pivot many chunks."""
    monkeypatch.setattr(bag_minhash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(bag_minhash, "CHUNK", 2)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(160)]
    rows = [(i, " ".join(common + [f"r{rng.randrange(14)}{k}" for k in range(28)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 0.8)
    assert 1 < len({c for _, c in want})
    assert sorted(tuple(r) for r in near_groups(docs).select("doc_id", "class_id").collect()) == want


def test_family_around_a_base_takes_one_comparison_each(spark, monkeypatch):
    """Copies of one base, near to it but hardly to each other: pairs grow with the members."""
    seen = []
    plain = bag_minhash.linked
    monkeypatch.setattr(bag_minhash, "linked", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    for n in (100, 200, 400):
        rng = random.Random(n)
        base = [f"b{i}" for i in range(300)]
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            copy = list(base)
            for _ in range(6):
                copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
        seen.clear()
        got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("class_id").distinct().collect()
        assert [r.class_id for r in got] == [0]
        assert sum(seen) < 4 * n


def test_one_row_of_each_class(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (None, "only null", "z"), (None, "only null", "z"), (9, None, "w"), (8, "", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string")
    got = sorted((tuple(r) for r in one_of_each_group(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "y"), (None, "only null", "z"), (8, "", "v")], key=str)


def test_bags_go_only_to_cells_with_pairs_to_verify(spark, monkeypatch):
    """Members that meet in buckets, but that no sketch brings near each other, move no bag."""
    met, plain = [], bag_minhash.cut_lineage
    monkeypatch.setattr(bag_minhash, "cut_lineage", lambda df, label="cut", **more: (met.append((df.count(), df.columns)) if label == "met" else None) or plain(df, label, **more))
    monkeypatch.setattr(bag_minhash, "BLOCK_ROWS", 16)
    rng = random.Random(4)
    # Only a third of the words are shared: many meet in bands of one row, none is near.
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join(common + [f"r{rng.randrange(10**6)}" for _ in range(130)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_groups(docs, bands=36, rows=1).select("class_id").distinct().count()
    assert got == 120 and [(n, "bag" in columns) for n, columns in met] == [(0, False)]
