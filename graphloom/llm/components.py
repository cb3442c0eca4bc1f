"""Connected components of an edge table by alternating stars; nothing but one flag a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node sends its larger (or its smaller) neighbours to the least of its neighbourhood.

    The least neighbour comes from a map-side combined minimum, is written, and is joined back: no neighbourhood is collected,
    and a node with many neighbours is a skewed join that adaptive execution splits.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = materialize(out.filter("a <> b").distinct(), "links")
    discard(least)
    return out


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a root: then the stars are the components."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up")))
    each = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not each.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0)))).first()[0]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of its component, for every node of an edge between two nodes.

    Rounds end as soon as the edges are stars, without a further round that changes nothing.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    while not _is_forest(now):
        large = _stars(now, True)
        small = _stars(large, False)
        discard(now, large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
