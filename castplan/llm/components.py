"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castplan.llm.shared import materialize


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges`` has distinct (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # large star: larger neighbours of u move to u's least neighbour
    large = (both.where(F.col("v") > F.col("u")).join(least, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    # small star: smaller neighbours and u itself move to u's least neighbour
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u")
    return (moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Rounds grow with the logarithm of the longest path; each round is two aggregations over the
    edges, written to shared storage, so neither a component nor the edges meet in one place.
    Self-loops and nulls are ignored; an empty edge table gives an empty result.
    """
    edges = (edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    edges = materialize(edges, "edges")
    state = None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        edges = materialize(_star(edges), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
