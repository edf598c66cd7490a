"""Byte-level BPE by replaying the merges over all distinct words of a corpus block.

Each task collects the distinct matches of the splitting pattern in a block of whole
texts and keeps an inverted index from merge rank (a pair of neighbouring tokens whose
bytes join to a token) to the positions of that pair. Ranks are taken in ascending order;
one step merges all positions of a rank at once and touches only their neighbours, whose
new pairs enter the index. Words are independent of each other, so blocks may be of any
size; encodings of a task's earlier blocks are kept.

If a merge makes a pair of lower rank than its own (ranks not learned by merging can do
so), order inside the word matters; such words are encoded again one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.pieces import PieceCache, blocks
from tidemark.llm.registry import once_per_worker, query, table, text_of

BLOCK_BYTES = 2 << 20
#: Encodings of words, and of pieces, a worker keeps from block to block; an entry takes about 200 bytes.
#: Later words are replayed where they occur.
KEPT_WORDS = 100_000
#: Distinct words replayed at once, in bytes; each takes some 80 bytes meanwhile.
REPLAY_BYTES = 1 << 19


@dataclass(frozen=True)
class Merges:
    """Ranks of a byte-level vocabulary, and all pairs of tokens that join to a token."""

    tokens: list  # bytes by rank
    pairs: object  # sorted left << 32 | right
    ranks: object  # rank of each pair's joined bytes


def read_merges(lines: bytes) -> Merges:
    """From the text of a rank file: base64 of the bytes, blank, rank, on each line."""
    import base64

    import numpy as np

    rank_of = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
    tokens = [b""] * (max(rank_of.values()) + 1)
    pairs, ranks = [], []
    for token, rank in rank_of.items():
        tokens[rank] = token
        for i in range(1, len(token)):
            left, right = rank_of.get(token[:i]), rank_of.get(token[i:])
            if left is not None and right is not None:
                pairs.append(left << 32 | right)
                ranks.append(rank)
    order = np.argsort(pairs)
    return Merges(tokens, np.array(pairs, np.int64)[order], np.array(ranks, np.int64)[order])


def replay(words: list[bytes], merges: Merges, rank_of: dict) -> list[bytes]:
    """Encodings of distinct words as little-endian 32-bit ids."""
    import heapq

    import numpy as np

    out = [b""] * len(words)
    todo = []
    for i, w in enumerate(words):
        whole = rank_of.get(w)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif w:
            todo.append(i)
    if not todo:
        return out
    none = np.int64(2**62)
    byte_rank = np.array([rank_of[bytes([b])] for b in range(256)], np.int64)
    lengths = np.array([len(words[i]) for i in todo], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    token = byte_rank[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    n = len(token)
    # Position n is a wall on both sides of every word.
    following, preceding = np.arange(1, n + 2), np.arange(-1, n)
    following[ends - 1], preceding[starts] = n, n
    following[n], preceding[n] = n, n
    token = np.append(token, -1)

    def pair_rank(at):
        """Rank of the pair at each position, or ``none``."""
        right = following[at]
        key = token[at] << 32 | token[right]
        i = np.minimum(np.searchsorted(merges.pairs, key), len(merges.pairs) - 1)
        return np.where((right < n) & (merges.pairs[i] == key), merges.ranks[i], none)

    current = np.append(pair_rank(np.arange(n)), none)
    index: dict[int, list] = {}
    heap: list[int] = []

    def enter(at, rank):
        keep = rank < none
        at, rank = at[keep], rank[keep]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            r = int(rank[a])
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(at[a:b])

    enter(np.arange(n), current[:n])
    again: list = []
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[current[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            touching = following[at[:-1]] == at[1:]
            if touching.any():
                # Of neighbouring pairs that overlap, the 1st, 3rd, ... merge.
                k = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(True, ~touching), k, 0))
                at = at[(k - run) % 2 == 0]
        gone = following[at]
        after = following[gone]
        token[at], following[at], current[gone] = rank, after, none
        preceding[after] = at
        preceding[n] = n
        before = preceding[at]
        touched = np.concatenate([at, before[before < n]])
        new = pair_rank(touched)
        current[touched] = new
        if (new < rank).any():
            again.append(touched[new < rank])
        enter(touched, new)

    left = np.flatnonzero(token[:n] >= 0)
    removed = np.zeros(n, bool)
    inner = following[:n]
    # A position lives on if its predecessor's link reaches it; starts always do.
    removed[:] = True
    removed[starts] = False
    live = starts
    while len(live):
        live = inner[live]
        live = live[live < n]
        removed[live] = False
    left = left[~removed[left]]
    ids = token[left].astype("<u4").tobytes()
    cuts = np.append(np.searchsorted(left, starts), len(left)).tolist()
    for i, a, b in zip(todo, cuts, cuts[1:]):
        out[i] = ids[4 * a : 4 * b]
    if again:
        for k in np.unique(np.searchsorted(starts, np.concatenate(again), side="right") - 1).tolist():
            out[todo[k]] = one_by_one(words[todo[k]], rank_of)
    return out


def one_by_one(word: bytes, rank_of: dict) -> bytes:
    """The rule itself: merge the leftmost pair of least rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((rank_of.get(a + b, 2**62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 2**62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return b"".join(rank_of[p].to_bytes(4, "little") for p in parts)


def corpus_encoder(merges: Merges, pattern: str):
    """Function from pieces of text to encodings, keeping words it has seen."""
    import regex

    rank_of = {t: i for i, t in enumerate(merges.tokens) if t}
    find = regex.compile(pattern).findall
    kept: dict[str, bytes] = {}

    def encode(pieces: list[str]) -> list[bytes]:
        found = [[p] if (p[1:] if p[:1] == " " else p).isalpha() else find(p) for p in pieces]
        new = list({w for ws in found for w in ws if w not in kept})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        own, size, first = {}, 0, 0
        for i, w in enumerate(raw):
            size += len(w)
            if size >= REPLAY_BYTES or i == len(raw) - 1:
                own.update(zip(new[first : i + 1], replay(raw[first : i + 1], merges, rank_of)))
                size, first = 0, i + 1
        room = max(0, KEPT_WORDS - len(kept))
        kept.update((w, own[w]) for w in new[:room])

        def get(word: str) -> bytes:
            ids = kept.get(word)
            return own[word] if ids is None else ids

        return [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in found]

    return encode


def encode_texts(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """``docs`` without its text, plus ``ids_col``: binary, little-endian 32-bit ids.

    ``ranks`` is the text of a rank file and ``pattern`` splits texts into words. With
    ``decoded_col`` the ids are decoded at once and the bytes added. Null and empty texts
    have no ids. Special tokens are ordinary text. Rows, their order inside a partition
    and other columns stay; an empty table stays empty. Columns of ``docs`` named as the
    new ones are replaced.
    """
    import hashlib

    merges = docs.sparkSession.sparkContext.broadcast(read_merges(ranks))
    key = f"merges {hashlib.sha256(ranks + pattern.encode()).hexdigest()}"
    added = [ids_col, *([decoded_col] if decoded_col else [])]
    keep = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{c}` binary" for c in added)])

    def encode(batches):
        import pyarrow as pa

        encoder = once_per_worker(key, lambda: corpus_encoder(merges.value, pattern))
        cache, tokens = PieceCache(encoder, KEPT_WORDS), merges.value.tokens
        for block in blocks(batches, text_col, BLOCK_BYTES):
            ids = cache.encode(block.column(text_col).to_pylist())
            at = 0
            for batch in block.select(names).to_batches(max_chunksize=256):
                own = ids[at : at + batch.num_rows]
                at += batch.num_rows
                columns = [pa.array(own, pa.binary())]
                if decoded_col:
                    columns.append(pa.array([decode_ids(i, tokens) for i in own], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added])

    return docs.select(*[f"`{n}`" for n in names], text_of(text_col).alias(text_col)).mapInArrow(encode, schema)


def decode_ids(ids: bytes, tokens: list) -> bytes:
    """Bytes that little-endian 32-bit ids stand for."""
    import numpy as np

    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def public_ranks() -> tuple[bytes, str]:
    """Rank file and pattern of the public 50k vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query()
def op6_byte_merges(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded by merge replay and decoded again."""
    ranks, pattern = public_ranks()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_texts(docs, ranks, pattern, decoded_col="decoded").select(
        "doc_id",
        F.call_function("div", F.octet_length("ids"), F.lit(4)).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
