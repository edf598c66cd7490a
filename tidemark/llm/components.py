"""Connected components by alternating large and small stars, as Spark joins.

Edges are only ever grouped for their minimum, which is summed map-side, so a hub with a
third of all edges is no single task's work; the join that brings the minimum back to the
edges is split by adaptive execution where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut_lineage


def _unsettled(links: DataFrame) -> bool:
    """Whether links (a, b), b smaller, are yet other than stars: a node has two or more
    smaller neighbours, or smaller and larger ones."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(n).alias("below")) for c, n in (("a", 1), ("b", 0))]
    degrees = links.select(F.inline(F.array(*ends))).groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return not degrees.filter("below > 1 or below > least").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a, b).

    component is the smallest node reachable. Loops, repeated and reversed edges are fine;
    rows with a null end are ignored; no edges give no rows. Links that are stars already
    take no round. The two halves of a round are queries of their own, so that plans stay
    short and the driver, which keeps and compiles them, small.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    loops = edges.filter("a = b").select("a", "b")
    links = edges.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()
    links = cut_lineage(links, "links")
    both_ways = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    while _unsettled(links):
        both = links.select(both_ways)
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large, "links", replaces=links)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = cut_lineage(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "links",
            replaces=large,
        )
    return (
        links.unionAll(links.select(F.col("b").alias("a"), "b")).unionAll(loops)
        .groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("component"))
    )
