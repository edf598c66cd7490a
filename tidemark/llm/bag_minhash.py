"""Near duplicates of documents as bags of word shingles, by BagMinHash.

A document is a bag: each run of five words with its number of occurrences. Weights are
discretised to whole levels, and the levels of an element are covered by intervals of
lengths 1, 1, 2, 4, ... with a Poisson process each, at a rate that grows with the
interval's length; a point carries a slot and a level and counts if the level is at most
the element's weight. The earliest point of a slot is its signature value, so two slots
agree with the probability of the weighted Jaccard similarity. Only points up to a time
by which all slots are almost surely filled are made (else the time is extended), so an
element costs little however large its weight is.

Signatures are banded. Bands are taken a few at a time. In a bucket, the members are first
compared with one pivot, the member that meets most others in all bands, so that the buckets
of a group share their pivot; only members of other components than the pivot's are, and
components are merged before the next bands. A group of copies, however large, thus costs
about one comparison a member. What buckets still hold of several components is compared in
cells of two blocks of members, in memory: sketches rule pairs out, and only the members left
with a pair to look at get their bags for a second turn, which verifies those pairs
unless the cell has linked their components already. No bucket is capped, no pair becomes a row, and, up
to the chance of the bands, no link between components is lost. Every pair that counts is
verified on whole bags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.components import components
from tidemark.llm.groups import first_of, whole_groups
from tidemark.llm.pieces import blocks
from tidemark.llm.registry import fresh, query, table, text_of
from tidemark.llm.wordhash import Hasher, mix, shingles
from tidemark.session import cut_lineage, release

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 36, 5
BLOCK_BYTES = 1 << 18
#: Points made of each process in its 1st, 2nd, ... turn; part of the definition.
TURNS = (1, 3, 12, 48)
#: Standard errors by which a sketch may miss the least similarity: a chance of 1e-6.
SLACK = 4.75
#: Members and bytes of bags of a block, about; a longer bag is a block of its own.
BLOCK_ROWS, BLOCK_BAGS = 1024, 4 << 20
#: Members compared with one pivot in one task.
CHUNK = 256


def bags(hasher: Hasher, texts: list[str], words: int = WORDS):
    """(document, element, weight) arrays, ascending, and the bag sizes."""
    import numpy as np

    hashes, offsets, *_ = hasher.words(texts)
    grams, cuts = shingles(hashes, offsets, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], grams[first], np.diff(np.append(first, len(grams))), np.diff(cuts)


def signatures(doc, element, weight, sizes, slots: int):
    """Array of one row of ``slots`` 64-bit values per document; rows of empty bags are 0."""
    import numpy as np

    u64 = np.uint64
    # One process per element and interval (lower, upper] of levels.
    depth = np.ceil(np.log2(weight)).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(doc)), depth)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
    length = np.where(j < 1, 1, 1 << np.maximum(j - 1, 0)).astype(np.float64)
    lower = np.where(j < 1, 0, 1 << np.maximum(j - 1, 0))
    seed = mix(element[owner] + (j.astype(np.uint64) + u64(1)) * u64(0x9E3779B97F4A7C15))
    rate, of_doc, level_most = length * slots, doc[owner], weight[owner]

    best = np.full((len(sizes), slots), np.inf)
    flat = best.reshape(-1)
    until = (np.log(slots) + 5.0) / np.maximum(sizes, 1)
    todo = np.arange(len(owner))
    while len(todo):
        live, time, made = todo, np.zeros(len(todo)), 0
        turn = 0
        while len(live):
            n = TURNS[min(turn, len(TURNS) - 1)]
            k = np.arange(made + 1, made + n + 1).astype(np.uint64) * u64(0xD1342543DE82EF95)
            limit = until[of_doc[live]]
            draw = mix(seed[live][:, None] + k)
            if not turn:
                # Most processes of a large bag have no point in time: leave before the logarithm.
                chance = -np.expm1(-rate[live] * limit)
                keep = draw[:, 0] >= ((1.0 - chance) * 2.0**64 * (1 - 1e-9)).clip(0, 2.0**64 - 2**12).astype(np.uint64)
                live, time, draw, limit = live[keep], time[keep], draw[keep], limit[keep]
            gap = -np.log(((draw >> u64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live][:, None]
            times = time[:, None] + np.cumsum(gap, axis=1)
            mark = mix(draw ^ u64(0xA0761D6478BD642F))
            level = lower[live][:, None] + 1 + (((mark & u64(0xFFFFFFFF)) * length[live].astype(np.uint64)[:, None]) >> u64(32)).astype(np.int64)
            slot = (((mark >> u64(32)) * u64(slots)) >> u64(32)).astype(np.int64)
            good = (times < limit[:, None]) & (level <= level_most[live][:, None])
            np.minimum.at(flat, (of_doc[live][:, None] * slots + slot)[good], times[good])
            time, made, turn = times[:, -1], made + n, turn + 1
            keep = time < limit
            live, time = live[keep], time[keep]
        short = np.isinf(best).any(axis=1) & (sizes > 0)
        until[short] *= 2.0
        todo = np.flatnonzero(short[of_doc])
    out = mix(best.view(np.uint64))
    out[sizes == 0] = 0
    return out


def occurrences(hasher: Hasher, texts: list[str], words: int = WORDS):
    """(numbers, offsets): the bag of each text as a set, ascending, one number per occurrence.

    Two sets share as many numbers as the bags share occurrences, so the Jaccard similarity
    of the sets is the weighted one of the bags.
    """
    import numpy as np

    doc, element, weight, sizes = bags(hasher, texts, words)
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    numbers = mix(np.repeat(element, weight) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    owner = np.repeat(doc, weight)
    return numbers[np.lexsort((numbers, owner))], np.concatenate([[0], np.cumsum(sizes)])


def similarity(a, b) -> float:
    """Jaccard similarity of two ascending arrays of distinct numbers."""
    import numpy as np

    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """uid, id, digest, size, sketch, bands: one row per document, kept in shared storage.

    digest tells texts apart, size is the bag's size, sketch has one byte per slot; bands
    is empty for texts without words.
    """

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        hasher, slots = Hasher(), bands * rows
        lanes = mix(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for block in blocks(batches, "text", BLOCK_BYTES):
            bag = bags(hasher, block.column("text").to_pylist(), words)
            sizes = bag[3]
            sig = signatures(*bag, slots)
            keys = mix((sig * lanes).reshape(len(sizes), bands, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)
            has = sizes > 0
            flat = pa.array(keys[has].reshape(-1))
            offsets = pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32())
            small = (sig >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.combine_chunks() for c in block.select(["uid", "id", "digest"]).columns),
                    pa.array(sizes, pa.int64()),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                names=["uid", "id", "digest", "size", "sketch", "bands"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return cut_lineage(
        docs.select("uid", "id", "digest", "text").mapInArrow(
            sketch, f"uid long, id {kind}, digest binary, size long, sketch binary, bands array<long>"
        ),
        "sketches",
    )


def bag_table(texts: DataFrame, words: int) -> DataFrame:
    """uid, bag: the numbers of ``occurrences`` of each text (uid, text), kept in shared storage."""

    def make(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher()
        for block in blocks(batches, "text", BLOCK_BYTES):
            numbers, offsets = occurrences(hasher, block.column("text").to_pylist(), words)
            offsets = pa.array(offsets * 8, pa.int64())
            bag = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.num_rows, [None, offsets.buffers()[1], pa.py_buffer(numbers)])
            yield pa.RecordBatch.from_arrays([block.column("uid").combine_chunks(), bag.cast(pa.binary())], names=["uid", "bag"])

    return cut_lineage(texts.select("uid", "text").mapInArrow(make, "uid long, bag binary"), "bags")


def linked(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) whose bags are at least ``least`` alike.

    b may be the pivot of any number of pairs: they are dealt to tasks in chunks, and only
    the pivot's bag is repeated, once per chunk.
    """
    columns = pairs.columns
    per_pivot = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(per_pivot, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    pivots = (
        per_pivot.join(bags.select(F.col("uid").alias("b"), F.col("bag").alias("bag_b")), "b")
        .select("b", "bag_b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    )
    both = dealt.join(bags.select(F.col("uid").alias("a"), F.col("bag").alias("bag_a")), "a").join(pivots, ["b", "chunk"])

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        n = len(columns)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(n), batch.column(n + 1)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                keep.append(similarity(a, b) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=columns).filter(pa.array(keep, pa.bool_()))

    return both.select(*columns, "bag_a", "bag_b").mapInArrow(compare, pairs.schema)


def links_in_cells(members: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components: enough to connect all that the members' buckets link.

    ``members`` (band, key, n, heavy, uid, component, size, sketch, keys) are those of
    buckets of n members, with ``heavy`` bytes of bags. Buckets are cut into blocks by hash,
    and each two blocks make a cell, so no task holds more than two blocks. A member is in as
    many cells as its buckets have blocks; its bag goes only to those where it has a pair to
    verify.
    """
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("heavy") / BLOCK_BAGS), F.lit(1)).cast("int")
    cut = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    celled = cut.withColumn("other", other).select(
        F.xxhash64("band", "key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"),
        F.when(F.col("part") < F.col("other"), 0).when(F.col("part") > F.col("other"), 1).otherwise(2).alias("side"),
        "band", "uid", "component", "size", "sketch", "keys",
    )

    def cells_of(batches):
        import numpy as np

        for cells in whole_groups(batches, "cell"):
            first = np.append(first_of(cells.column("cell").to_numpy()), cells.num_rows)
            for a, b in zip(first, first[1:]):
                yield cells.slice(a, b - a)

    def meet(batches):
        for cell in cells_of(batches):
            pairs = _chances(cell, least)
            if pairs:
                yield from cell.take(sorted({k for _, i, j in pairs for k in (i, j)})).to_batches()

    def compare(batches):
        import pyarrow as pa

        for cell in cells_of(batches):
            found = _links_in_cell(cell, least)
            a, b = ([f[k] for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def by_cell(rows):
        return rows.repartition("cell").sortWithinPartitions("cell")

    met = cut_lineage(by_cell(celled).mapInArrow(meet, celled.schema), "met")
    return by_cell(met.join(bags, "uid")).mapInArrow(compare, "a long, b long")


def _chances(cell, least: float) -> list:
    """(-estimate, i, j) of the pairs of rows that are looked at in this cell."""
    import numpy as np

    n = cell.num_rows
    side, band, component, size = (cell.column(c).to_numpy() for c in ("side", "band", "component", "size"))
    if n < 2 or (component == component[0]).all():
        return []
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    slots = sketch.shape[1]
    keys = np.array(cell.column("keys").to_pylist(), np.int64)
    least_same = least - SLACK * np.sqrt(least * (1 - least) / slots)
    chances = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        # Two whole blocks meet across; a block alone meets itself.
        rest = rest[(component[rest] != component[i]) & ((side[rest] == 2) | (side[rest] != side[i]))]
        small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[small >= least * large]
        # Bytes agree by chance once in 256 times.
        same = ((sketch[rest] == sketch[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        rest, same = rest[same >= least_same], same[same >= least_same]
        # A pair is looked at in the first bucket it shares.
        own = (keys[rest] == keys[i]).argmax(axis=1) == band[0]
        chances += [(-s, i, j) for s, j in zip(same[own].tolist(), rest[own].tolist())]
    return chances


def _links_in_cell(cell, least: float) -> list:
    import numpy as np

    component = cell.column("component").to_numpy()
    root: dict = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    bags: dict = {}

    def bag(i):
        if i not in bags:
            bags[i] = np.frombuffer(cell.column("bag")[i].as_buffer(), np.uint64)
        return bags[i]

    out = []
    for _, i, j in sorted(_chances(cell, least)):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b and similarity(bag(i), bag(j)) >= least:
            root[a] = b
            out.append((int(component[i]), int(component[j])))
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after joining the components that ``links`` (a, b) connect."""
    if links.isEmpty():
        return labels
    roots = components(links).withColumnRenamed("component", "root")
    return cut_lineage(
        labels.join(roots, labels["component"] == roots["node"], "left")
        .withColumn("component", F.coalesce("root", "component")).select(*labels.columns),
        "labels",
        replaces=labels,
    )


def _open(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels, and the buckets that hold several components, with their pivot."""
    placed = members.join(labels, "uid")
    buckets = (
        placed.groupBy("band", "key")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.max_by(F.struct("uid", "component", "size"), F.struct("popular", "uid")).alias("pivot"),
        )
        .filter("low <> high").select("band", "key", "pivot")
    )
    return placed, buckets


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, digest (MD5 of the text), class_key, class_id, class_size.

    A class is a component of documents linked by a weighted Jaccard similarity of at
    least ``least``; class_id is its smallest id. Equal texts share a class, null counting
    as empty; a text of fewer words than a shingle has one shingle of all its words; texts
    without words are near nothing but equal texts. A class whose ids are all null has a
    null class_id; class_key, a row number, still tells it from others. An empty table gives no rows. Other columns are ignored.
    """
    text = text_of(text_col)
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    sketched = sketches(named.withColumn("uid", F.monotonically_increasing_id()), words, bands, rows)

    # One node per distinct text.
    nodes = sketched.groupBy("digest").agg(F.min("uid").alias("uid"))
    single = sketched.join(nodes.select("uid"), "uid", "left_semi")
    keyed = cut_lineage(single.select("uid", F.posexplode("bands").alias("band", "key")), "bands")
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(
        keyed.join(shared, ["band", "key"]).select("band", "key", "uid", "n"), "members", replaces=keyed
    )
    popular = members.groupBy("uid").agg(F.sum("n").alias("popular"))
    labels = cut_lineage(
        popular.join(single.select("uid", "size"), "uid").withColumn("component", F.col("uid")), "labels"
    )
    wanted = labels.select("uid").join(sketched.select("uid", "digest"), "uid")
    # Copies are reduced before the shuffle, so a common text is no task's burden.
    texts = named.groupBy("digest").agg(F.min("text").alias("text")).join(wanted, "digest")
    bag = bag_table(texts, words)

    ends = sorted({0, 1, bands // 9, bands // 3, bands})
    for low, high in zip(ends, ends[1:]):
        placed, buckets = _open(members.filter((F.col("band") >= low) & (F.col("band") < high)), labels)
        near = F.least("size", "pivot.size") >= least * F.greatest("size", "pivot.size")
        pairs = (
            placed.join(buckets, ["band", "key"]).filter(near & (F.col("component") != F.col("pivot.component")))
            .select(F.col("uid").alias("a"), F.col("pivot.uid").alias("b"), "component", F.col("pivot.component").alias("other"))
            .distinct()
        )
        pairs = cut_lineage(pairs, "pairs")
        links = cut_lineage(
            linked(pairs, bag, least).select(F.col("component").alias("a"), F.col("other").alias("b")).distinct(), "links"
        )
        labels = _merged(labels, links)
        release(pairs)
        release(links)

    # A pivot has been compared with all its bucket.
    placed, buckets = _open(members, labels)
    rest = placed.join(buckets, ["band", "key"]).filter("uid <> pivot.uid")
    several = (
        rest.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("heavy"))
        .filter("low <> high").select("band", "key", "n", "heavy")
    )
    rest = cut_lineage(rest.select("band", "key", "uid", "component", "size").join(several, ["band", "key"]), "rest")
    sketch = single.select("uid", "sketch", F.col("bands").alias("keys"))
    links = cut_lineage(links_in_cells(rest.join(sketch, "uid"), bag, least).distinct(), "links")
    labels = _merged(labels, links)

    of_text = nodes.join(labels.select("uid", "component"), "uid", "left").select(
        "digest", F.coalesce("component", "uid").alias("component")
    )
    per_text = sketched.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(of_text, "digest")
    classes = per_text.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    labelled = cut_lineage(
        per_text.join(classes, "component").select("digest", F.col("component").alias("class_key"), "class_id", "class_size"), "classes"
    )
    return sketched.select(F.col("id").alias(id_col), "digest").join(labelled, "digest")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one of smallest id, null last, then of least digest.

    Columns are those of ``docs``. Each whole text is shuffled once, by its digest.
    """
    groups = near_groups(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "digest")).alias("first")
    digest, kept, own = fresh(docs, "_digest"), fresh(docs, "_kept"), fresh(docs, "_own")
    chosen = groups.groupBy("class_key").agg(first).select(F.col("first.digest").alias(digest), F.col("first.id").alias(kept))
    # Copies differ in id, so a common text is spread over tasks.
    return (
        docs.withColumn(own, F.unhex(F.md5(text_of(text_col).cast("binary"))))
        .join(chosen, (F.col(own) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(kept)))
        .dropDuplicates([digest])
        .select(*[f"`{c}`" for c in docs.columns])
    )


@query()
def op4_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the class of their near duplicates."""
    return near_groups(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")
