"""Connected components of a table of links, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cleanframe.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round is two small stars: minima are combined before the shuffle, so a node with many links is no hot spot of
    the aggregation. Rounds grow with the logarithm of a component's size; each is written and cuts the lineage. They end
    when a round leaves all links as they were: equal sums tell that it may have, a comparison of the tables that it has.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    before = _fingerprint(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        last = edges
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        edges = written(
            small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(small.select(F.col("m").alias("a"), "b")).filter("a < b").distinct(),
            "links",
        )
        after = _fingerprint(edges)
        if after == before and edges.join(last, ["a", "b"], "left_anti").isEmpty():
            break
        before = after
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
