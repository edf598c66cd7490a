"""Near duplicates of vectors: random-hyperplane hashing, exact cosines, components.

Equal vectors of one label are one node with a multiplicity. In each of several tables a
node's bucket is its label and the signs of its products with random hyperplanes. Buckets
are cut into blocks of bounded size and every two blocks of a bucket meet once, in a task
that multiplies them as matrices, so a bucket of any size is spread over tasks and none is
capped. Two nodes count in the first table where they meet. A task returns sums and a
spanning forest of its links, not the links.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.components import components
from tidemark.llm.groups import whole_groups
from tidemark.llm.registry import query, table
from tidemark.session import cut_lineage

LEAST = 0.98
#: Chance that a link of cosine LEAST is in no bucket of any table.
LOSS = 6e-6
#: Bits of a code at least, and the nodes a bucket has on average at most.
LEAST_BITS, BUCKET_NODES = 14, 4096
BLOCK = 512
SEED = 11


def usable(column: Column) -> Column:
    """Vectors that can be compared: no null or non-finite component, not all zero."""
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def shape_for(nodes: int, least: float = LEAST, loss: float = LOSS) -> tuple[int, int]:
    """(tables, bits): codes grow with the logarithm of the nodes, so that buckets of unlike
    vectors keep their size, and tables with them, so that no more links are missed."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(nodes, 1) / BUCKET_NODES)))
    meet = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(loss) / math.log1p(-meet)), bits


def planes(dims: int, tables: int, bits: int, seed: int):
    import numpy as np

    return np.random.RandomState(seed).standard_normal((dims, tables * bits))


def codes_of(vectors, tables: int, bits: int, seed: int):
    """Bucket numbers, one row per vector and one column per table."""
    import numpy as np

    signs = vectors @ planes(vectors.shape[1], tables, bits, seed) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def unit(lists, dims: int):
    """Rows of an Arrow list array as vectors of length 1, in double precision."""
    import numpy as np

    x = lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), dims)
    # Squares of very large or small components don't fit a double.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST,
    loss: float = LOSS,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id.

    Rows are compared if their labels are equal and not null and their vectors have equal
    length; a link is a cosine of at least ``least`` in double precision. n_links counts
    the other rows linked directly, copies included; component_id is the smallest id
    reachable, the row's own included. Vectors that are null, zero or hold null or
    non-finite components, and rows without a label, have no links and are components of
    their own. Rows of equal id and equal vector count as two. An empty table gives no
    rows; other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), F.monotonically_increasing_id().alias("row")
    )
    fit = usable(F.col("vector")) & F.col("label").isNotNull()
    rows = cut_lineage(
        rows.withColumn("digest", F.when(fit, F.md5(F.to_json(F.struct("label", "vector")).cast("binary")))), "vectors"
    )
    nodes = cut_lineage(
        rows.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "nodes",
    )

    tables, bits = shape_for(nodes.count(), least, loss)

    def bucket(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            lengths = lists.value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(at))
                x = unit(part.column(3), dims)
                codes = codes_of(x, tables, bits, seed)
                n = len(at)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(2),
                            pa.array(np.full(n, dims), pa.int32()),
                            pa.array(np.full(n, t), pa.int32()),
                            pa.array(codes[:, t], pa.int64()),
                            part.column(0),
                            part.column(1),
                        ],
                        names=["label", "dims", "tab", "code", "node", "copies"],
                    )

    kind = vectors.schema[label_col].dataType.simpleString()
    key = ["label", "dims", "tab", "code"]
    narrow = nodes.select("node", "copies", "label", "vector").mapInArrow(
        bucket, f"label {kind}, dims int, tab int, code long, node long, copies long"
    )
    # Buckets of one node need no partner; blocks come from hashes, so no bucket is sorted whole.
    placed = cut_lineage(narrow, "placed")
    counts = placed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    placed = placed.join(counts.select(*key, n_blocks.alias("blocks")), key).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    # A node goes to every pair of blocks that has its own; vectors join only now.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select(
        F.xxhash64(*key, F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        *key, "node", "copies", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
    ).join(nodes.select("node", "vector"), "node")
    cell = ["cell", *key, "left", "right"]
    dealt = paired.repartition("cell").sortWithinPartitions(*cell)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def links(t, left, right, node, copies, own, x):
            """Sums and forest of one cell, or None without a link."""
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if left != right:
                near &= (own == left)[:, None] != (own == left)[None, :]
            if t and near.any():
                codes = codes_of(x, tables, bits, seed)
                i, j = np.nonzero(near)
                near[i, j] = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
            sums = near @ copies
            held = np.flatnonzero(sums)
            if not len(held):
                return None
            near, root = near[np.ix_(held, held)], np.arange(len(held))
            while True:
                new = np.minimum(root, np.where(near, root[None, :], len(held)).min(axis=1))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            return node[held], sums[held], node[held][root]

        def cells(table):
            """Results of all cells of a table that holds whole cells."""
            key_names = ["cell", "dims", "tab", "code", "left", "right"]
            k = {n: table.column(n).to_numpy() for n in [*key_names, "node", "copies", "own"]}
            labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for values in (labels, *(k[n] for n in key_names)):
                new[1:] |= values[1:] != values[:-1]
            cuts = np.append(np.flatnonzero(new), table.num_rows).tolist()
            vectors = table.column("vector").combine_chunks()
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    x = unit(vectors.slice(a, b - a), int(k["dims"][a]))
                    out.append(links(int(k["tab"][a]), k["left"][a], k["right"][a], k["node"][a:b], k["copies"][a:b], k["own"][a:b], x))
            out = [o for o in out if o]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "root"])

        for table in whole_groups(batches, "cell"):
            yield from cells(table)

    found = cut_lineage(
        dealt.select(*cell, "node", "copies", "own", "vector").mapInArrow(compare, "node long, links long, root long"), "found"
    )
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = cut_lineage(
        nodes.select("digest", "node", "copies").join(sums, "node", "left").join(merged, "node", "left")
        .select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "per-node",
    )
    smallest = rows.groupBy("digest").agg(F.min("id").alias("id")).join(per_node, "digest").groupBy("component").agg(F.min("id").alias("component_id"))
    told = per_node.join(smallest, "component").select("digest", "n_links", "component_id")
    return rows.join(told, "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


SQL = f"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT * FROM r),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id,
  vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN roots ON roots.a = vec_id
"""


@query(SQL)
def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings with their links and components."""
    return link_vectors(table(spark, folder, "embeddings")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
