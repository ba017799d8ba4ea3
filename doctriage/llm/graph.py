"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import forget, stored


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both long; root is the smallest node reachable.

    Alternates two contractions until nothing changes: every node hands its
    larger neighbours to the smallest node it knows, then its smaller ones.
    The depth of the links at least halves, so rounds grow with the logarithm
    of the longest chain.  Hot nodes are aggregated before the shuffle; the aggregates are
    stored, as adaptive execution splits a hot node's rows only where both sides of a
    join come straight from a shuffle.  NULLs and loops are left out.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        # a > b throughout: each row is a node and a smaller neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        nearest = stored(nearest, "nearest")
        large = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "links-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = stored(small, "links-small")
        for table in (edges, nearest, large, least):
            forget(table)
        now = _mark(after)
        edges = after
        if now == mark:
            break
        mark = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
