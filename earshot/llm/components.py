"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.tables import written

SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Alternates two steps until nothing changes: each node's larger neighbours are joined to
    its least neighbour, then its smaller ones. Both keep the components, and a path of n
    nodes shrinks to a star in a logarithmic number of rounds. Least neighbours are taken
    with partial sums, and rows of a node with many edges are spread by salts, so no task
    holds all edges of one node.
    """
    now = written(_ordered(edges))
    state = _state(now)
    while True:
        now = written(_small(_large(now)))
        before, state = state, _state(now)
        if state == before:
            break
    # every edge is now (node, least node)
    least = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        least.select("node", F.col("node").alias("component"))
    )


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least of u and all v of that u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _ordered(_with_least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return _ordered(down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b"))))
