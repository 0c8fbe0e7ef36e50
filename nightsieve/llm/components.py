"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour to the neighbours above it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its lower neighbours and itself to the least of them; edges point down here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest reachable node.

    Stars alternate until nothing changes.  Per-node minima are partial aggregates and the joins carry no hint, so
    a node with very many neighbours can be split.  Each round is staged.  Self-loops and nulls count for nothing.
    """
    high, low = F.greatest(first, second), F.least(first, second)
    now = edges.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    now = staged(now.select(high.alias("a"), low.alias("b")).where("a <> b").distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    before = now.agg(F.count(F.lit(1)).alias("n"), mark).first()
    while before["n"]:
        now = staged(_small(_large(now)), "edges")
        after = now.agg(F.count(F.lit(1)).alias("n"), mark).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
