"""Token files and merge replay against the tokenizer libraries."""

import base64
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_merges
from tidemark.llm.byte_merges import Merges, encode_texts, one_by_one, public_ranks, read_merges, replay
from tidemark.llm.pieces import PieceCache, blocks
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.session import scratch_dir

ODD = [
    None, "", " ", "  ", "\n", "a", " a  b", "a \n b", "x\x1c y\x1c", "it's we'll 're", "a\t b", "x  y  z", "é 12 34٣ !!!\n\n  z ",
    "aaaaaaaaaa " * 50, "北京北京 😀😀", "===== <|endoftext|> -- ", "a<|endoftext|>b  <|endoftext|>\n\n<|endoftext|> c", "one two<|endoftext|> three", "a" * 5000, "word, " * 20000, "é​ x",
]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab c!é=-1\n'.,T") for _ in range(rng.randint(1, 80))) for _ in range(300)]


def frame(spark):
    rows = [(None if i == 4 else i - i % 7 if i % 31 == 0 else i, t, "x", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, row int"), rows


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in public_ranks()[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_files_round_trip(spark):
    docs, rows = frame(spark)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = scratch_dir(spark, "tokens-test")
    write_token_files(docs.repartition(5), path, definition)
    got = read_token_files(spark, path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)


def test_special_tokens_as_text(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = scratch_dir(spark, "tokens-test")
    text = "so <|endoftext|> it is"
    write_token_files(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, definition, special_as_text=True)
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    assert read_token_files(spark, path).first().n_tokens == len(tokenizer.encode(text).ids) + 1


def test_pieces_outlive_blocks_and_are_dropped():
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [p.upper().encode() for p in pieces]

    cache = PieceCache(encode, most=3)
    for given in (["a b c", "", "b\tc", " d  e"], ["a b c"], [], ["x y z w"], ["a b"]):
        assert cache.encode(given) == [t.upper().encode() for t in given]
    assert asked.count(" b") == 2 and asked.count(" c") == 1 and set(cache.tails) <= {"x", "y", "z", "w", "a", "b"}


def test_token_files_of_nothing(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = scratch_dir(spark, "tokens-test")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, definition)
    assert read_token_files(spark, path).collect() == []


def test_merge_replay_equals_library(spark):
    docs, rows = frame(spark)
    ranks, pattern = public_ranks()
    out = encode_texts(docs, ranks, pattern, decoded_col="decoded")
    assert out.columns == ["doc_id", "row", "ids", "decoded"]
    encoding = library()
    for r in out.collect():
        text = rows[r.row][1] or ""
        assert bytes(r.ids) == np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.decoded) == text.encode()


def test_merge_replay_of_nothing(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), *public_ranks()).collect() == []


def test_ranks_that_merging_cannot_learn():
    """A merge that makes a pair of lower rank: such words are encoded one by one."""
    extra = ["xab", "ab", "bc", "abc", "aa", "aaa", "ba"]
    lines = "\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([bytes([b]) for b in range(256)] + [e.encode() for e in extra]))
    merges = read_merges(lines.encode())
    assert isinstance(merges, Merges)
    rank_of = {t: i for i, t in enumerate(merges.tokens)}
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 12))).encode() for _ in range(3000)})
    want = []
    for w in words:
        whole = rank_of.get(w)
        want.append(whole.to_bytes(4, "little") if whole is not None else one_by_one(w, rank_of))
    assert replay(words, merges, rank_of) == want


def test_byte_merges_hold_few_words():
    """However many distinct words a worker meets, what it keeps and holds meanwhile stays small."""
    ranks, pattern = public_ranks()
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioustrnl", k=8))
    batches = [pa.record_batch({"text": [" ".join(word() for _ in range(1000)) for _ in range(30)]}) for _ in range(10)]
    cache = PieceCache(byte_merges.corpus_encoder(read_merges(ranks), pattern), byte_merges.KEPT_WORDS)
    made = 0
    tracemalloc.start()
    for block in blocks(batches, "text", byte_merges.BLOCK_BYTES):
        made += len(cache.encode(block.column("text").to_pylist()))
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert made == 300 and kept < 40e6 and most < 200e6
