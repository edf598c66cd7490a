"""Runs of words that repeat with a period, found by block convolution.

A run is a stretch of words with smallest period q, at least ``max(24, 3 * q)`` long, that
no neighbouring word extends. At scale B the words are cut into blocks of B; a run of period
q in [2B, 4B) holds a whole block together with the block's copy q words on, because it is
at least 3q long. (At the first scale, q in [1, 4B): a run is at least 3B long.) So for every
block the sums of squared differences to all windows at these distances are computed, as
squares minus twice a correlation by number-theoretic transforms modulo a prime. The sum
is 0 wherever the block occurs again, so no occurrence is lost; a sum that is 0 only
modulo the prime is sorted out by comparing words. Distances with sum 0 seed extensions to
both sides, and what comes out is a run if it is long enough and no divisor of the
distance is a period.

Two kinds of blocks need no convolution: those with a word that doesn't come again within
reach, and those whose reach lies in a run already found with a period of at most B (all
their distances are multiples of it). Texts are handled many at a time, laid end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.pieces import blocks
from tidemark.llm.registry import query, table, text_of

#: Fixed values of the definition.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of a block at the first scale: a third of LEAST_WORDS.
FIRST_BLOCK = 8
#: A prime with 2**23 dividing PRIME - 1, and a generator of its multiplicative group.
PRIME = 998_244_353
GENERATOR = 3
BLOCK_BYTES = 2 << 20
#: Numbers transformed at a time.
CELLS = 1 << 19


class Transform:
    """Number-theoretic transforms of the rows of arrays whose width is a power of two."""

    def __init__(self):
        self.roots: dict = {}

    def _twiddles(self, width: int, inverse: bool):
        import numpy as np

        if (width, inverse) not in self.roots:
            levels, size = [], width
            while size > 1:
                root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
                root = pow(root, -1, PRIME) if inverse else root
                powers = np.ones(size // 2, np.int64)
                done = 1
                while done < len(powers):
                    more = min(done, len(powers) - done)
                    powers[done : done + more] = powers[:more] * pow(root, done, PRIME) % PRIME
                    done += more
                levels.append(powers)
                size //= 2
            self.roots[width, inverse] = levels
        return self.roots[width, inverse]

    def forward(self, a):
        """Decimation in frequency: natural order in, bit-reversed order out."""
        width = a.shape[1]
        for powers in self._twiddles(width, False):
            a = a.reshape(-1, 2, len(powers))
            top, low = a[:, 0], a[:, 1]
            a = self._stack((top + low) % PRIME, (top - low) * powers % PRIME)
        return a.reshape(-1, width)

    def backward(self, a):
        """The inverse, from bit-reversed to natural order."""
        width = a.shape[1]
        for powers in reversed(self._twiddles(width, True)):
            a = a.reshape(-1, 2, len(powers))
            top, low = a[:, 0], a[:, 1] * powers % PRIME
            a = self._stack((top + low) % PRIME, (top - low) % PRIME)
        return a.reshape(-1, width) * pow(width, -1, PRIME) % PRIME

    @staticmethod
    def _stack(top, low):
        import numpy as np

        out = np.empty((len(top), 2, top.shape[1]), np.int64)
        out[:, 0], out[:, 1] = top, low
        return out


class Finder:
    """Finds runs in texts laid end to end; keeps the transform's tables between calls."""

    def __init__(self):
        self.transform = Transform()

    def runs(self, words, sizes) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, ascending by start and period.

        ``words`` are numbers that tell words apart, 1 at least and below ``PRIME``, of all
        texts one after the other; ``sizes`` are the texts' lengths. Starts count from the
        first word of all; no run crosses from one text into another.
        """
        import numpy as np

        n = len(words)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = first + np.repeat(sizes, sizes)
        reach = self._next(words, last)
        far = np.zeros(n, np.int64)  # end of a known run of short period around each word
        found: list = []
        waiting: list = []
        size, longest = FIRST_BLOCK, int(sizes.max(initial=0))
        while True:
            least, most = (1 if size == FIRST_BLOCK else 2 * size), 4 * size - 1
            if longest < max(LEAST_WORDS, LEAST_PERIODS * least):
                return sorted(found)
            for start, length, period in [r for r in waiting if r[2] <= size]:
                part = far[start : start + length]
                np.maximum(part, start + length, out=part)
            waiting = [r for r in waiting if r[2] > size]
            whole = n // size
            at = np.arange(whole) * size
            comes_again = reach[: whole * size].reshape(whole, size).max(axis=1) <= most
            at = at[comes_again & (at + size + least <= last[at])]
            at = at[far[at] < np.minimum(at + size + most, last[at])]
            new = []
            rows = max(1, CELLS // (4 * size))
            for k in range(0, len(at), rows):
                seeds = self._occurrences(words, last, at[k : k + rows], size, least, most)
                new += self._extend(words, first, last, *seeds, size)
            new = sorted(set(new))
            found += new
            waiting += new
            size *= 2

    def _next(self, words, last):
        """Distance from each word to its next occurrence in the text, or a huge number."""
        import numpy as np

        order = np.argsort(words, kind="stable")
        out = np.full(len(words), np.iinfo(np.int64).max)
        here, there = order[:-1], order[1:]
        good = (words[here] == words[there]) & (there < last[here])
        out[here[good]] = (there - here)[good]
        return out

    def _occurrences(self, words, last, at, size: int, least: int, most: int):
        """(start, distance) where the squared differences of a block and a window sum to 0."""
        import numpy as np

        span = most - least + size
        width = 1 << (span + size - 2).bit_length()
        place = (at + least)[:, None] + np.arange(span)
        window = np.zeros((len(at), width), np.int64)
        window[:, :span] = np.where(place < last[at][:, None], words[np.minimum(place, len(words) - 1)], 0)
        block = np.zeros((len(at), width), np.int64)
        block[:, :size] = words[at[:, None] + np.arange(size)]
        own = (block[:, :size] * block[:, :size] % PRIME).sum(axis=1)
        sums = np.zeros((len(at), span + 1), np.int64)
        np.cumsum(window[:, :span] * window[:, :span] % PRIME, axis=1, out=sums[:, 1:])
        block[:, :size] = block[:, :size][:, ::-1].copy()
        product = self.transform.forward(block) * self.transform.forward(window) % PRIME
        cross = self.transform.backward(product)[:, size - 1 : size + most - least]
        squares = own[:, None] + sums[:, size:] - sums[:, : most - least + 1] - 2 * cross
        row, shift = np.nonzero(squares % PRIME == 0)
        distance = shift + least
        good = at[row] + distance + size <= last[at[row]]
        return at[row][good], distance[good]

    def _extend(self, words, first, last, starts, distances, size: int):
        """Runs around seeds, which ascend by start and distance."""
        import numpy as np

        live = np.ones(len(starts), bool)
        out = []
        for k in range(len(starts)):
            if not live[k]:
                continue
            at, q = int(starts[k]), int(distances[k])
            stop = int(last[at])
            right = at + _agreeing(words[at : stop - q], words[at + q : stop])
            if right < at + size:
                continue  # the sum was 0 modulo the prime only
            begin = int(first[at])
            left = at - _agreeing(words[begin:at][::-1], words[begin + q : at + q][::-1])
            end = right + q
            # Other seeds inside this stretch: the same one, or multiples of its period.
            below = int(np.searchsorted(starts, end))
            near = slice(k, below)
            inside = starts[near] + distances[near] + size <= end
            if end - left >= max(LEAST_WORDS, LEAST_PERIODS * q) and _primitive(words[left : left + 2 * q], q):
                out.append((left, end - left, q))
                live[near] &= ~(inside & (distances[near] % q == 0))
            else:
                live[near] &= ~(inside & (distances[near] == q))
        return out


def _agreeing(a, b) -> int:
    """How many first elements of two arrays agree; looks further in growing steps."""
    import numpy as np

    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        k = int(np.argmax(differ)) if len(differ) else 0
        if differ[k]:
            return at + k
        at, step = at + step, step * 2
    return n


def _primitive(two, q: int) -> bool:
    """No proper divisor of q is a period of the first q words of ``two``, which has period q."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = q // f
            if (two[:q] == two[d : d + q]).all():
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs, collapsed.

    Words are what ASCII white space separates, numbered from 0. runs lists every run
    (start, length, period) by start, then period. collapsed joins by one blank the words
    that no run holds after its first period. ``rewrite``, if given, maps (id, words as
    bytes) to the words to use. A null or empty text has no words, no runs and an empty
    collapsed text. Null and repeated ids are kept as they are; an empty table gives no
    rows; other columns are ignored.
    """

    def find(batches):
        import numpy as np
        import pyarrow as pa

        finder = Finder()
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids = block.column("id").combine_chunks()
            texts = [t.split() for t in block.column("text").to_pylist()]
            if rewrite is not None:
                texts = [rewrite(i, t) for i, t in zip(ids.to_pylist(), texts)]
            sizes = np.array([len(t) for t in texts], np.int64)
            numbers: dict = {}
            number = numbers.setdefault
            words = np.array([number(w, len(numbers) + 1) for t in texts for w in t], np.int64)
            begins = np.cumsum(sizes) - sizes
            per_text: list = [[] for _ in texts]
            for start, length, period in finder.runs(words, sizes):
                k = int(np.searchsorted(begins, start, side="right")) - 1
                per_text[k].append({"start": start - int(begins[k]), "length": length, "period": period})
            joined = []
            for t, runs in zip(texts, per_text):
                if runs:
                    keep = np.ones(len(t), bool)
                    for r in runs:
                        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    t = [t[i] for i in np.flatnonzero(keep)]
                joined.append(b" ".join(t))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(per_text, pa.list_(run)), pa.array(joined, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    found = named.mapInArrow(
        find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return found.withColumnRenamed("id", id_col)


def looped(doc_id, words: list) -> list:
    """Words of a document, the tail of every tenth one repeating: the contract's test rows."""
    import zlib

    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their number of runs, the run of greatest exponent, and digests."""
    found = periodic_runs(table(spark, folder, "documents"), rewrite=looped)
    best = F.expr(
        "aggregate(runs, runs[0], (best, r) -> if(r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
