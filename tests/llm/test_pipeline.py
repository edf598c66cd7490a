"""The pipeline's stages against their own definitions, computed in plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_groups import brute
from tests.llm.test_shards_and_mix import targets_by_hand

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good, single, hidden, mixed, encoded = kept

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    accepted = {r.doc_id for r in good}
    assert np.mean([(i in accepted) == (q == 1) for i, q in labels.items()]) > 0.95

    classes = brute([(r.doc_id, r.text) for r in good], 0.8)
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in classes})

    before = {r.doc_id: r for r in single}
    assert set(before) == {r.doc_id for r in hidden}
    for r in hidden:
        assert "@" not in r.text or not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        assert r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id].text):
            assert r.text == before[r.doc_id].text

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for r in hidden:
        sizes[r.source] += words(r.text)
    order = sorted(sizes)
    want = targets_by_hand(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    longest = max(words(r.text) for r in hidden)
    got = Counter()
    for r in mixed:
        got[r.source] += words(r.text)
    assert all(abs(got[s] - want[s]) <= longest for s in order)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in encoded)
    for r in encoded:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_stages_with_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, and a column named as ours."""
    rows = [(1, "the same words here again", "en", "a", 25, "x"), (1, "the same words here again", "en", "a", 25, "x"), (None, None, None, None, None, None)]
    rows += [(2, "", "en", None, 0, "x"), (3, "Mail me@site.example.org now", "en", "b", 10, "x"), (None, "no id in this row", "en", "b", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score string")
    single = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted(str(r.text) for r in single.collect()) == sorted(["the same words here again", "", "Mail me@site.example.org now", "no id in this row"])
    assert single.columns == docs.columns
    assert corpus_pipeline.keep_good(spark, docs, FOLDER).columns == docs.columns
    assert {r.text for r in corpus_pipeline.hide_personal_data(spark, docs, FOLDER).collect()} >= {"Mail [EMAIL] now", None}
    assert corpus_pipeline.mix_sources(spark, docs, FOLDER).columns == docs.columns
    assert corpus_pipeline.encode(spark, docs, FOLDER).count() == len(rows)
