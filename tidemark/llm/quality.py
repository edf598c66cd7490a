"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words and pairs of words, and runs of one to
three word shapes (letter case, digits and marks, runs collapsed; a word that repeats the
one before it has a shape of its own). Each indicator is scaled by the log ratio of its
smoothed class counts, over all labelled rows; a linear hinge-loss model on the scaled,
length-normalised indicators is then fitted by dual coordinate descent on a bounded sample
of labelled rows, and a sigmoid on margins of held-back halves turns margins into scores.

Labels of documents with crc32(id as text) mod ``folds`` = 0 are never used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.pieces import blocks
from tidemark.llm.registry import fresh, query, table, text_of
from tidemark.llm.wordhash import Hasher, mix

BITS = 18
FOLDS = 5
#: Labelled rows of each class that the hinge-loss model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.3
BLOCK_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    weights: object  # per hashed n-gram: model weight times log-count ratio
    bias: float
    slope: float
    shift: float


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    """Rows whose labels must not be learnt from; a null id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


class Features:
    """Distinct hashed n-grams of texts."""

    def __init__(self, bits: int = BITS):
        import numpy as np

        self.bits, self.hasher = bits, Hasher()
        classes = np.arange(256, dtype=np.uint8)
        classes[ord("A") : ord("Z") + 1] = ord("A")
        classes[ord("a") : ord("z") + 1] = ord("a")
        classes[ord("0") : ord("9") + 1] = ord("0")
        classes[128:] = ord("a")
        self.classes = classes

    def of(self, texts: list[str]):
        """(n-grams, offsets by text), each text's n-grams distinct and ascending."""
        import numpy as np

        words, offsets, data, starts, ends = self.hasher.words(texts)
        n = len(words)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        first = np.zeros(n, bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True

        kind = self.classes[data]
        kept = np.ones(len(data), bool)
        kept[1:] = kind[1:] != kind[:-1]
        kept[starts] = True
        place = np.cumsum(kept)
        shape = self.hasher.stream(kind[kept], place[starts] - 1, place[ends - 1]) if n else words
        if n:
            again = np.append(False, words[1:] == words[:-1]) & ~first
            shape = np.where(again, np.uint64(0x5EED), shape)

        def run(h, length, salt):
            """Hashes of ``length`` neighbours in the same text; those that don't fit are marked."""
            out, fits = h * np.uint64(0xA0761D6478BD642F), np.ones(n, bool)
            for k in range(1, length):
                fits[:k] = False
                fits[k:] &= doc[k:] == doc[:-k]
                out[k:] = out[k:] * np.uint64(0xE7037ED1A0B428DB) + h[:-k]
            return mix(out + np.uint64(salt))[fits], doc[fits]

        parts = [run(words, 1, 1), run(words, 2, 2), run(shape, 1, 3), run(shape, 2, 4), run(shape, 3, 5)]
        bits = np.uint64(self.bits)
        keys = np.concatenate([d.astype(np.uint64) << bits | h >> (np.uint64(64) - bits) for h, d in parts])
        keys = np.unique(keys)
        grams = (keys & np.uint64((1 << self.bits) - 1)).astype(np.int32)
        return grams, np.searchsorted(keys >> bits, np.arange(len(texts) + 1).astype(np.uint64))


def class_counts(rows: DataFrame, bits: int):
    """Rows of each class in which each n-gram occurs: array of two rows, and class sizes.

    Each task sums its rows first; what reaches the driver is at most 2**bits rows.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        features, sums, sizes = Features(bits), np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for block in blocks(batches, "text", BLOCK_BYTES):
            grams, offsets = features.of(block.column("text").to_pylist())
            label = block.column("label").to_numpy()
            of_gram = np.repeat(label, np.diff(offsets))
            for k in (0, 1):
                sums[k] += np.bincount(grams[of_gram == k], minlength=1 << bits)
                sizes[k] += (label == k).sum()
        seen = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(seen, -1), pa.int32()),
                *(pa.array(np.append(sums[k][seen], sizes[k]), pa.int64()) for k in (0, 1)),
            ],
            names=["gram", "bad", "good"],
        )

    found = (
        rows.select("text", "label")
        .mapInArrow(count, "gram int, bad long, good long")
        .groupBy("gram")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toArrow()
    )
    counts, sizes = np.zeros((2, 1 << bits)), np.zeros(2)
    gram = found.column("gram").to_numpy()
    for k, name in enumerate(("bad", "good")):
        values = found.column(name).to_numpy()
        counts[k][gram[gram >= 0]] = values[gram >= 0]
        sizes[k] = values[gram < 0].sum()
    return counts, sizes


class Scaled:
    """For each row of n-grams their ratios over the row's length, made when asked for: as
    arrays of their own they would be twice the rows, all on the driver."""

    def __init__(self, rows: list, ratio):
        self.rows, self.ratio = rows, ratio

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int):
        import numpy as np

        row = self.rows[i]
        return self.ratio[row] / max(np.sqrt(len(row)), 1.0)


def hinge_fit(rows: list, values: list, labels, dims: int, cost, epochs: int = 12, seed: int = 7):
    """Dual coordinate descent for the L1-loss linear SVM; the last weight is the bias."""
    import numpy as np

    rng = np.random.RandomState(seed)
    weights, dual = np.zeros(dims + 1), np.zeros(len(rows))
    squares = [float(v @ v) + 1.0 for v in values]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y, x, v = labels[i], rows[i], values[i]
            gradient = y * (weights[x] @ v + weights[-1]) - 1.0
            new = min(max(dual[i] - gradient / squares[i], 0.0), cost[i])
            step = (new - dual[i]) * y
            if step:
                dual[i] = new
                weights[x] += step * v
                weights[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def sigmoid_fit(margins, good, share: float):
    """Slope and shift of P(good | margin), with the sample reweighted to ``share`` good."""
    import numpy as np

    n_good, n_bad = good.sum(), (~good).sum()
    weight = np.where(good, share / n_good, (1 - share) / n_bad)
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x, w = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-6 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = BITS,
    per_class: int = SAMPLE_PER_CLASS,
    folds: int = FOLDS,
) -> Model:
    """Model from the labels (0 or 1; others are ignored) of documents not held out.

    Counts cover all labelled rows; at most ``per_class`` rows of each class, those of
    least hash of the id, train the hinge-loss model. Null texts count as empty, repeated
    rows count repeatedly. With labels of one class or none, all scores are the share of
    class 1 (one half without labels).
    """
    import numpy as np

    usable = labels.filter(~held_out(id_col, folds) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # A sort-merge join at every size: labels may be as many as documents, and a labelled
    # document's text is shuffled once.
    counts, sizes = class_counts(texts.hint("merge").join(usable, "id"), bits)
    if not sizes.all():
        share = sizes[1] / sizes.sum() if sizes.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    smooth = counts + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    by_hash = [F.xxhash64("id"), F.col("id")]
    picked = None
    for k in (0, 1):
        some = usable.filter(F.col("label") == k).orderBy(*by_hash).limit(per_class)
        picked = some if picked is None else picked.unionAll(some)

    def extract(batches):
        import pyarrow as pa

        features = Features(bits)
        for block in blocks(batches, "text", BLOCK_BYTES):
            grams, offsets = features.of(block.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams))
            whole = block.column("label").combine_chunks()
            ids = block.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, whole, lists], names=["id", "label", "grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = (
        # Bounded by per_class, so the list of picked rows may be broadcast.
        texts.join(F.broadcast(picked), "id")
        .select("id", "label", "text")
        .mapInArrow(extract, f"id {kind}, label int, grams array<int>")
        .toArrow()
    )
    order = np.argsort(sample.column("id").to_numpy(), kind="stable")
    label = sample.column("label").to_numpy()[order]
    # Views of the batches as they came, so the sample is held once.
    rows = []
    for lists in sample.column("grams").chunks:
        flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        rows += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    rows = [rows[i] for i in order]
    values = Scaled(rows, ratio)
    sign = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, 1.0, max(1.0, (label == 1).sum() / max((label == 0).sum(), 1)))

    def part(which):
        at = np.flatnonzero(which)
        own = [rows[i] for i in at]
        return hinge_fit(own, Scaled(own, ratio), sign[at], 1 << bits, cost[at])

    halves, margins = np.arange(len(rows)) % 2 == 0, np.zeros(len(rows))
    for half in (halves, ~halves):
        if len(set(label[half])) == 2:
            w = part(half)
            for i in np.flatnonzero(~half):
                margins[i] = w[rows[i]] @ values[i] + w[-1]
    good = label == 1
    slope, shift = (
        sigmoid_fit(margins, good, sizes[1] / sizes.sum()) if good.any() and not good.all() else (1.0, 0.0)
    )
    weights = part(np.ones(len(rows), bool))
    return Model((weights[:-1] * ratio).astype(np.float32), float(weights[-1]), max(slope, 1e-3), shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the estimated chance of label 1, also for empty texts.

    Only the text is an input. Rows and columns stay; a column of that name is replaced.
    """
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))
    keep = [f for f in docs.schema.fields if f.name != score_col]
    names, text_name = [f.name for f in keep], fresh(docs, "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{score_col}` double"])

    def apply(batches):
        import pyarrow as pa

        features, m = Features(bits), shared.value
        for block in blocks(batches, text_name, BLOCK_BYTES):
            for part in block.combine_chunks().to_batches():
                grams, offsets = features.of(part.column(part.num_columns - 1).to_pylist())
                sums = np.concatenate([[0.0], np.cumsum(m.weights[grams], dtype=np.float64)])
                counts = np.diff(offsets)
                margin = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(counts, 1)) + m.bias
                scores = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], names=[*names, score_col])

    return docs.select(*[f"`{n}`" for n in names], text_of(text_col).alias(text_name)).mapInArrow(apply, schema)


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their quality scores."""
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
