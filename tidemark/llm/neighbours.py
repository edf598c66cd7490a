"""Approximate nearest neighbours by inner product: NN-descent graph, greedy search.

Equal vectors are one node. The graph starts from sorted random-hyperplane codes: nodes
next to each other in a code order are compared. NN-descent then improves it: every node
gathers a sample of its neighbours and of the nodes it is a neighbour of, a join brings
their vectors, all sampled pairs with a new member are compared, and better neighbours
are merged into both lists. Rounds stop when few entries change.

Queries walk the graph greedily: each round expands the best unexpanded nodes of each
query's list, joins their neighbours and vectors, and merges the scores. The best of the
final lists are scored again in double precision on the original vectors.

Every step is a join or a shuffle by node or query. Lists are bounded by the method's own
sample sizes, before the shuffle too, so a hub is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.groups import as_lists, blocks_of, first_of, rank_in_group, whole_groups
from tidemark.llm.near_vectors import usable
from tidemark.llm.registry import query, table
from tidemark.llm.wordhash import mix
from tidemark.session import cut_lineage

NEAREST = 20
#: Neighbours a node keeps, members it gathers in a round, and pairs each member offers.
DEGREE, SAMPLE, OFFERS = 40, 48, 4
ORDERS, LEAF, CODE_BITS = 8, 64, 16
ROUNDS = 8
STOP = 0.02
#: Length of a query's list, nodes expanded in a round, rounds, and candidates scored exactly.
WIDTH, EXPAND, SEARCH_ROUNDS, EXACT = 240, 32, 8, 120
SEED = 3

LISTS = "node long, ids array<long>, scores array<float>, new boolean"
GRAPH = "node long, ids array<long>, scores array<float>, new array<boolean>"


def prepare_nodes(vectors: DataFrame, id_col: str, vector_col: str, keep_ids: int):
    """(nodes: node, vector, raw; members: node, id, nth; rows: id, node).

    node is the row number of one of the equal vectors. raw is the norm, as a share of the
    greatest component of all, in double precision and the vector of norm 1 in half precision, so norms
    may differ by any factor. members has the ``keep_ids`` smallest ids of a node.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.monotonically_increasing_id().alias("row")
    ).filter(usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1)
    rows = rows.withColumn("dims", F.size("vector")).join(F.broadcast(common.select("dims")), "dims")
    rows = cut_lineage(rows.withColumn("digest", F.md5(F.to_json(F.struct("vector")).cast("binary"))), "ann-rows")
    nodes = rows.groupBy("digest").agg(F.min("row").alias("node"), F.first("vector").alias("vector"))
    # Greatest components instead of norms: their squares may not fit a double.
    size = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    most = nodes.agg(F.max(size)).first()[0] or 1.0

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            sizes = np.abs(x).max(axis=1, keepdims=True)
            x = x / sizes
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            shares = (norms * (sizes / most)).astype("<f8")
            raw = pa.array([n.tobytes() + v.tobytes() for n, v in zip(shares, (x / norms).astype("<f2"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=["digest", "node", "vector", "raw"])

    kind = vectors.schema[vector_col].dataType.simpleString()
    nodes = cut_lineage(
        nodes.select("digest", "node", "vector").mapInArrow(pack, f"digest string, node long, vector {kind}, raw binary"), "ann-nodes"
    )
    of_row = rows.select("id", "digest").join(nodes.select("digest", "node"), "digest").select("id", "node")
    of_row = cut_lineage(of_row, "ann-ids")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = of_row.withColumn("nth", nth).filter(F.col("nth") <= keep_ids)
    return nodes.select("node", "vector", "raw"), members, of_row


def unpack(column):
    """(vectors of norm 1, norms) of a binary column in single precision.

    The inner product of two such vectors times the norm of the second orders the second
    ones of a first one as inner products do."""
    import numpy as np

    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    norms, units = rows[:, :8].copy().view("<f8"), rows[:, 8:].copy().view("<f2")
    return units.astype(np.float32), norms[:, 0].astype(np.float32)


def first_lists(nodes: DataFrame, orders: int, leaf: int, seed: int) -> DataFrame:
    """Lists from neighbours in several random orders."""

    def code(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, _ = unpack(batch.column(1))
            rng = np.random.RandomState(seed)
            for t in range(orders):
                planes = rng.standard_normal((x.shape[1], CODE_BITS + 1))
                place = x @ planes
                codes = (place[:, :-1] > 0) @ (1 << np.arange(CODE_BITS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(codes.astype(np.int64)), pa.array(place[:, -1]), *batch.columns],
                    names=["turn", "code", "place", "node", "raw"],
                )

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        for block in blocks_of(batches, "turn", leaf):
            node = block.column("node").to_numpy()
            for a in range(0, len(node), 64 * leaf):
                out = []
                for b in range(a, min(a + 64 * leaf, len(node)), leaf):
                    own = node[b : b + leaf]
                    x, norms = unpack(block.column("raw").slice(b, len(own)))
                    s = (x @ x.T) * norms
                    np.fill_diagonal(s, -np.inf)
                    best = np.argsort(-s, axis=1, kind="stable")[:, : min(DEGREE // 3, len(own) - 1)]
                    if best.size:
                        out.append((np.repeat(own, best.shape[1]), own[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
                if out:
                    yield lists_batch(*map(np.concatenate, zip(*out)))

    coded = nodes.select("node", "raw").mapInArrow(code, "turn int, code long, place double, node long, raw binary")
    order = ["turn", "code", "place", "node"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pairs, LISTS)


def lists_batch(i, j, score):
    """Offers of neighbour j to node i as one row of lists per node."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(i, kind="stable")
    node, ids, scores = as_lists(i[order], j[order], score[order].astype(np.float32))
    return pa.RecordBatch.from_arrays([node, ids, scores, pa.array(np.ones(len(node), bool))], names=["node", "ids", "scores", "new"])


def merged(lists: DataFrame, degree: int) -> DataFrame:
    """One row per node: its ``degree`` best neighbours, with marks for those just found."""

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        for block in whole_groups(batches, "node"):
            lengths = block.column("ids").combine_chunks().value_lengths().to_numpy()
            node = np.repeat(block.column("node").to_numpy(), lengths)
            new = np.repeat(block.column("new").to_numpy(zero_copy_only=False).astype(bool), lengths)
            ids = block.column("ids").combine_chunks().flatten().to_numpy()
            scores = block.column("scores").combine_chunks().flatten().to_numpy()
            order = np.lexsort((new, ids, node))
            node, new, ids, scores = node[order], new[order], ids[order], scores[order]
            keep = np.ones(len(node), bool)
            keep[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
            node, new, ids, scores = node[keep], new[keep], ids[keep], scores[keep]
            order = np.lexsort((ids, -scores, node))
            order = order[rank_in_group(node[order]) < degree]
            yield pa.RecordBatch.from_arrays(
                as_lists(node[order], ids[order], scores[order], new[order]), names=["node", "ids", "scores", "new"]
            )

    return cut_lineage(lists.repartition("node").sortWithinPartitions("node").mapInArrow(merge, GRAPH), "graph")


def gathered(graph: DataFrame, sample: int, turn: int) -> DataFrame:
    """(center, member, fresh): for each node a sample of its neighbours in both directions.

    New entries come first, then by hash. Each task cuts its own lists to the sample size
    before the shuffle.
    """

    def cut(center, member, fresh):
        import numpy as np

        chance = mix(center.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(member.astype(np.uint64) + np.uint64(turn)))
        order = np.lexsort((member, chance, ~fresh, center))
        center, member, fresh = center[order], member[order], fresh[order]
        keep = np.ones(len(center), bool)
        keep[1:] = (center[1:] != center[:-1]) | (member[1:] != member[:-1])
        center, member, fresh = center[keep], member[keep], fresh[keep]
        short = rank_in_group(center) < sample
        return center[short], member[short], fresh[short]

    def both_ways(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(1)
            node = np.repeat(batch.column(0).to_numpy(), ids.value_lengths().to_numpy())
            other, new = ids.flatten().to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(bool)
            c, m, f = cut(np.concatenate([node, other]), np.concatenate([other, node]), np.concatenate([new, new]))
            yield pa.RecordBatch.from_arrays(as_lists(c, m, f), names=["center", "members", "fresh"])

    def final(batches):
        import numpy as np
        import pyarrow as pa

        for block in whole_groups(batches, "center"):
            members, fresh = block.column("members").combine_chunks(), block.column("fresh").combine_chunks()
            center = np.repeat(block.column("center").to_numpy(), members.value_lengths().to_numpy())
            c, m, f = cut(center, members.flatten().to_numpy(), fresh.flatten().to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(m), pa.array(f)], names=["center", "member", "fresh"])

    return (
        graph.select("node", "ids", "new")
        .mapInArrow(both_ways, "center long, members array<long>, fresh array<boolean>")
        .repartition("center")
        .sortWithinPartitions("center")
        .mapInArrow(final, "center long, member long, fresh boolean")
    )


def offers(members: DataFrame, sample: int, each: int) -> DataFrame:
    """Compare all members of a center, and offer each the best that beat its worst neighbour."""

    def compare(batches):
        import numpy as np

        for block in whole_groups(batches, "center"):
            center = block.column("center").to_numpy()
            first = first_of(center)
            out = []
            for g in range(0, len(first), 1024):
                starts = first[g : g + 1024]
                a, b = starts[0], first[g + 1024] if g + 1024 < len(first) else len(center)
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b)))
                column = rank_in_group(center[a:b])
                part = block.slice(a, b - a)
                x, lengths = unpack(part.column("raw"))
                norms = np.zeros((len(starts), sample), np.float32)
                full = np.zeros((len(starts), sample, x.shape[1]), np.float32)
                member = np.full((len(starts), sample), -1, np.int64)
                fresh, worst = np.zeros((len(starts), sample), bool), np.full((len(starts), sample), np.inf, np.float32)
                full[row, column] = x
                norms[row, column] = lengths
                member[row, column] = part.column("member").to_numpy()
                fresh[row, column] = part.column("fresh").to_numpy(zero_copy_only=False)
                worst[row, column] = part.column("worst").to_numpy()
                s = (full @ full.transpose(0, 2, 1)) * norms[:, None, :]
                use = (member[:, None, :] >= 0) & (fresh[:, :, None] | fresh[:, None, :]) & (s > worst[:, :, None])
                use &= member[:, :, None] != member[:, None, :]
                s = np.where(use, s, -np.inf)
                best = np.argpartition(-s, min(each, sample - 1), axis=2)[:, :, :each]
                value = np.take_along_axis(s, best, 2)
                r, i, k = np.nonzero(value > -np.inf)
                out.append((member[r, i], member[r, best[r, i, k]], value[r, i, k]))
            i, j, score = map(np.concatenate, zip(*out))
            if len(i):
                yield lists_batch(i, j, score)

    return members.repartition("center").sortWithinPartitions("center").mapInArrow(compare, LISTS)


def neighbour_graph(
    nodes: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS, stop: float = STOP, seed: int = SEED
) -> DataFrame:
    """node, ids, scores, new: the neighbour lists of all nodes that have any, best first."""
    graph = merged(first_lists(nodes, ORDERS, LEAF, seed), degree)
    for turn in range(rounds):
        worst = graph.select(
            F.col("node").alias("member"),
            F.when(F.size("ids") < degree, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1)).cast("float").alias("worst"),
        )
        known = nodes.select(F.col("node").alias("member"), "raw").join(worst, "member")
        members = gathered(graph, sample, turn).join(known, "member").select("center", "member", "fresh", "raw", "worst")
        old = graph.select("node", "ids", "scores", F.lit(False).alias("new"))
        graph = merged(old.unionAll(offers(members, sample, OFFERS)), degree)
        changed, entries = graph.agg(
            F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("ids"))
        ).first()
        if not entries or changed <= stop * entries:
            break
    return graph


def greedy_search(
    queries: DataFrame, nodes: DataFrame, graph: DataFrame, width: int = WIDTH, expand: int = EXPAND, rounds: int = SEARCH_ROUNDS
) -> DataFrame:
    """(q, node, score): the lists of all query nodes after a greedy walk from themselves.

    ``queries`` has a column q of nodes. A round ends the walk of a query that has no
    unexpanded node among its best; the walk of all ends after ``rounds``.
    """
    links = graph.select("node", "ids")
    state_type = "q long, raw binary, ids array<long>, scores array<float>, done array<boolean>, frontier array<long>"

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        for block in whole_groups(batches, "q"):
            q = block.column("q").to_numpy()
            first = np.append(first_of(q), len(q))
            rows = []
            for a, b in zip(first, first[1:]):
                part = block.slice(a, b - a)
                cand = part.column("cand")
                at = int(np.flatnonzero(cand.is_null().to_numpy())[0])
                own = part.column("state_raw")[at].as_py()
                ids = np.array(part.column("ids")[at].as_py(), np.int64)
                scores = np.array(part.column("scores")[at].as_py(), np.float32)
                done = np.array(part.column("done")[at].as_py(), bool)
                part = part.filter(cand.is_valid())
                if part.num_rows:
                    new = part.column("cand").to_numpy()
                    x, norms = unpack(part.column("raw").combine_chunks())
                    s = (x @ np.frombuffer(own[8:], "<f2").astype(np.float32)) * norms
                    fresh = ~np.isin(new, ids)
                    ids = np.concatenate([ids, new[fresh]])
                    scores = np.concatenate([scores, s[fresh]])
                    done = np.concatenate([done, np.zeros(fresh.sum(), bool)])
                best = np.lexsort((ids, -scores))[:width]
                ids, scores, done = ids[best], scores[best], done[best]
                ahead = np.flatnonzero(~done)[:expand]
                done[ahead] = True
                rows.append((int(q[a]), own, ids.tolist(), scores.tolist(), done.tolist(), ids[ahead].tolist()))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["q", "raw", "ids", "scores", "done", "frontier"]
            )

    def listed(kind: str):
        return F.array().cast(f"array<{kind}>")

    start = queries.join(nodes.select(F.col("node").alias("q"), "raw"), "q")
    state = start.select(
        "q", "raw", F.array("q").alias("ids"), F.array(F.lit(float("inf")).cast("float")).alias("scores"),
        F.array(F.lit(True)).alias("done"), F.array("q").alias("frontier"),
    )
    for _ in range(rounds):
        ahead = state.select("q", F.explode("frontier").alias("node"))
        reached = ahead.join(links, "node").select("q", F.explode("ids").alias("cand")).distinct()
        scored = reached.join(nodes.select(F.col("node").alias("cand"), "raw"), "cand")
        nothing = F.lit(None)
        rows = state.select(
            "q", nothing.cast("long").alias("cand"), nothing.cast("binary").alias("raw"), F.col("raw").alias("state_raw"), "ids", "scores", "done"
        ).unionAll(
            scored.select(
                "q", "cand", "raw", nothing.cast("binary").alias("state_raw"),
                listed("long").alias("ids"), listed("float").alias("scores"), listed("boolean").alias("done"),
            )
        )
        state = cut_lineage(rows.repartition("q").sortWithinPartitions("q").mapInArrow(walk, state_type), "walk")
        if state.filter(F.size("frontier") > 0).isEmpty():
            break
    return state.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "q", F.col("x.ids").alias("node"), F.col("x.scores").alias("score")
    )


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, exact: int = EXACT
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products found per query.

    ``is_query`` is a condition on the id column. Candidates are all rows but the query's
    own, which copies of its vector are not; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components, or whose length isn't the most
    frequent one, take no part. Ids are expected to be unique: rows that repeat a query's id
    are left out of its answer. Fewer candidates than ``k`` give fewer rows; an empty table
    gives none.
    """
    nodes, members, of_row = prepare_nodes(vectors, id_col, vector_col, k + 1)
    graph = neighbour_graph(nodes)
    asked = of_row.filter(is_query(F.col("id"))).select(F.col("node").alias("q"), F.col("id").alias("query_id"))
    found = greedy_search(asked.select("q").distinct(), nodes, graph)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    close = found.withColumn("nth", nth).filter(F.col("nth") <= exact).select("q", "node")
    pairs = close.join(nodes.select("node", "vector"), "node").join(
        nodes.select(F.col("node").alias("q"), F.col("vector").alias("asked")), "q"
    )

    def product(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for i in (2, 3)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * y).sum(axis=1))], names=["q", "node", "score"])

    scored = pairs.select("q", "node", "vector", "asked").mapInArrow(product, "q long, node long, score double")
    place = F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))
    best = scored.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
    answers = best.join(members.select("node", F.col("id").alias("vec_id")), "node").join(asked, "q").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest embeddings of every 20th embedding."""
    return nearest(table(spark, folder, "embeddings"), lambda c: c % 20 == 0)
