"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.sources.store import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    Each round is group-bys with map-side minima and equi-joins; each is written to the
    shared folder. Ends when a round changes nothing, after about log(nodes) rounds.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _state(current)
        if now == before:
            roots = current.select("b").distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
            )
        before = now


def _state(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: equal tables have equal ones."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.expr("CAST(xxhash64(a, b) AS DECIMAL(38, 0))"))).first())
