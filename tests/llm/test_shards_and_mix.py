"""Shards and mixes against plain Python, with degenerate rows."""

import math
import re
import zlib

import pytest

from tidemark.llm.mixing import mix, mixed_documents
from tidemark.llm.shards import balanced_shards

SCHEMA = "doc_id long, text string, source string, size int, shard string, key string"


def rows_of(n=300):
    rows = []
    for i in range(n):
        text = None if i % 41 == 0 else "" if i % 43 == 0 else "é" * (i % 7) + " wörd" * (i * i % 97)
        source = None if i % 11 == 0 else "a" if i % 3 else f"s{i % 5}"
        rows.append((None if i % 50 == 7 else i // 2 if i % 29 == 0 else i, text, source, 1, "x", "y"))
    rows += [(5, "long " * 20000, "b", 1, "x", "y")] + [(6, "same", "b", 1, "x", "y")] * 40
    return rows


@pytest.mark.parametrize("cell", [7, 10**6])
def test_shards_are_balanced_and_contiguous(spark, cell):
    rows = rows_of()
    got = balanced_shards(spark.createDataFrame(rows, SCHEMA), shards=7, rows_per_cell=cell).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows
    )
    longest, total = max(r.size for r in got), sum(r.size for r in got)
    last = None
    for shard in sorted({r.shard for r in got}):
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
        assert abs(sum(r.size for r in own) - total / 7) <= longest


def test_shards_of_nothing(spark):
    assert balanced_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def targets_by_hand(sizes, weights):
    """Fill up by weight, freezing every source that reaches its limit, until none does."""
    frozen, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in frozen]
        rest = total - sum(frozen.values())
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return frozen | share
        for s in over:
            frozen[s] = 3 * sizes[s]


@pytest.mark.parametrize("cell", [5, 10**6])
def test_mix_meets_targets(spark, cell):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs, rows_per_cell=cell).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = targets_by_hand(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(sum(v) for v in taken.values()) == sum(math.floor(t + 1e-9) for t in want.values())
    for (size, target), values in taken.items():
        assert any(size == sizes[s] and abs(target - want[s]) < 1e-6 for s in sizes)
    again = mix(docs.repartition(5), rows_per_cell=cell).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = spark.createDataFrame([(1, "", None, 1, "", ""), (2, None, "a", 1, "", "")], SCHEMA)
    assert {(r.size, r.target, r.taken) for r in mix(empty).collect()} == {(0, 0.0, 0)}
    assert mixed_documents(empty).collect() == []


def test_mixed_documents_keep_columns(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = out.selectExpr("sum(size(filter(split(text, '[ \\t-\\r]+'), w -> w <> '')))").first()[0]
    total = sum(len((t or "").split()) for _, t, *_ in rows_of())
    assert 0.7 * total < words < 1.3 * total


def test_copies_of_equal_rows_are_exact(spark, monkeypatch):
    """1,000 equal rows of which a part is taken come out as often as the mix says."""
    monkeypatch.setattr("tidemark.llm.mixing.ROWS_PER_COPY_CELL", 64)
    rows = [(7, "one two", "a", i % 3, "x", "y") for i in range(1000)] + [(None, "six", "a", 1, "x", "y")] * 33
    rows += [(100 + i, "word " * 40, "b", 1, "x", "y") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for r in mix(docs).collect():
        if r.size:
            want[r.doc_id] = want.get(r.doc_id, 0) + (2 * r.taken + r.size) // (2 * r.size)
    got = {r.doc_id: r["count"] for r in mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
    # Shares differ by one copy at most.
    assert want[7] % 1000, "the case must need an uneven share"
    assert sum(n for n in got.values()) > 0
