"""Connected components of a graph given as links, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step towards stars around the smallest node: each node hands its (larger, or smaller) neighbours to the smallest one."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written before it is joined: a join right behind a grouping can't split a node with very many links
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (of one orderable type, no null). Returns node, root: the smallest node of its component.

    Nodes without a link to another don't appear. Each round is written to the shared folder; the
    rounds needed grow with the logarithm of the longest path. The driver sees three sums a round.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(mark)
        now = materialize(_stars(_stars(now, True), False), "links")
