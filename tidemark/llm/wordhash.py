"""Hashes of the words of many texts at once, in numpy, inside tasks.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over a
random table of byte values, taken from prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

#: Odd multipliers and seeds; any would do, but results depend on them.
MULTIPLIER = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
LANES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def mix(h):
    """Finaliser that spreads every bit of 64-bit values over all bits."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Keeps tables that grow with the longest block seen."""

    def __init__(self):
        import numpy as np

        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER)) | np.uint64(1)
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) >= n:
            return
        for name, base in (("powers", STEP), ("inverse", pow(STEP, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def stream(self, data, starts, ends):
        """Hashes of data[start:end] for each start and end."""
        import numpy as np

        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def bounds(self, data):
        """Starts and ends of the words in a byte array."""
        import numpy as np

        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.white[data]
        edges = np.diff(inside)
        return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def words(self, texts: list[str]):
        """(hashes of all words, offsets of each text's words, bytes, starts, ends)."""
        import numpy as np

        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        starts, ends = self.bounds(data)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        return self.stream(data, starts, ends), np.searchsorted(starts, begins), data, starts, ends


def shingles(hashes, offsets, size: int):
    """(hashes of runs of ``size`` words, offsets by text).

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    import numpy as np

    n = len(hashes)
    lanes = [np.uint64(x) for x in LANES]
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(lengths.dtype))
    first = np.repeat(offsets[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    width = np.repeat(np.minimum(lengths, size), counts)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        word = padded[np.minimum(first + k, n)]
        out += np.where(k < width, word, np.uint64(0)) * lanes[k % len(lanes)]
    return mix(out), np.concatenate([[0], np.cumsum(counts)])
