"""Cutting texts into pieces that a byte-level BPE tokenizer encodes independently.

The tokenizer's pattern never lets a match run from other than white space into white
space, so a text may be cut before any blank that follows a non-blank. Distinct pieces
are then encoded once per block instead of once per occurrence.
"""

from __future__ import annotations

import re

#: White space for Python that the pattern may treat otherwise, or that it may group.
_ODD = re.compile(r"[^\S \n\t\r\x0b\x0c]")
_BEFORE_BLANK = re.compile(r"\s ")
_CHUNK = re.compile(r"\s*\S+|\s+")


def can_cut(text: str) -> bool:
    """Whether the text's first word, and each other word with the blank before it, may be
    encoded on their own, words being what single blanks separate."""
    return text[0] != " " and text[-1] != " " and not _ODD.search(text) and not _BEFORE_BLANK.search(text)


def chunks(text: str) -> list[str]:
    """Independent pieces of any text."""
    if not text:
        return []
    return [text] if _ODD.search(text) else _CHUNK.findall(text)


def blocks(batches, text_column: str, most_bytes: int):
    """Arrow tables of about ``most_bytes`` of text each, whatever the size of the batches.

    A text longer than that is a table of its own.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text_column)))
        ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most_bytes - size, side="right")))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - done)
            at = stop
            if size >= most_bytes or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class PieceCache:
    """Encodings of pieces as bytes; ``encode_pieces`` maps a list of pieces to a list.

    Pieces stay from block to block. When there are more than ``most``, those of the latest
    block stay, common pieces among them.
    """

    def __init__(self, encode_pieces, most: int = 500_000):
        self.encode_pieces, self.most = encode_pieces, most
        self.tails: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """One byte string per text: the encodings of its pieces in order."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        even = [bool(t) and can_cut(t) for t in texts]
        # Words of all even texts, as numbers of the block's distinct words.
        words = pc.split_pattern(pa.array([t for t, e in zip(texts, even) if e], pa.large_string()), " ")
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        tails = self.tails
        found = list(map(tails.get, distinct))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(missing, self.encode_pieces([" " + distinct[k] for k in missing])):
            found[k] = tails[distinct[k]] = ids
        # A text's first word has no blank before it; other texts are pieces of their own.
        first = words.offsets.to_numpy()
        heads = words.flatten().take(pa.array(first[:-1])).to_pylist()
        whole = [chunks(t) for t, e in zip(texts, even) if not e]
        own = list(dict.fromkeys([*heads, *(c for one in whole for c in one)]))
        own = dict(zip(own, self.encode_pieces(own)))

        place = numbered.indices.to_numpy().astype(np.int64)
        place[first[:-1]] = len(distinct) + np.arange(len(heads))
        known = pa.array([*found, *map(own.__getitem__, heads)], pa.large_binary())
        taken = known.take(pa.array(place))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(place) + 1][first].tolist()
        data = memoryview(data) if data is not None else memoryview(b"")
        cut = (bytes(data[a:b]) for a, b in zip(ends, ends[1:]))
        rest = (b"".join(map(own.__getitem__, one)) for one in whole)
        out = [next(cut) if e else next(rest) for e in even]
        if len(tails) > self.most:
            self.tails = dict(zip(distinct, found))
        return out
