"""Connected components of a graph of any size, by alternating large and small stars.

Each round is two aggregations by node and two joins back; no node's neighbours are ever gathered, so that a hub with a
third of all edges is summed before the shuffle and its rows are split by Spark's skew join. Rounds end when the edges
stay the same; there are about log(longest path) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches. Loops and null ends are no edges."""
    edges = edges.filter(f"{src} is not null and {dst} is not null and {src} != {dst}")
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    while state[0]:
        before, edges = edges, written(_small(_large(edges)).filter("u != v").distinct(), "edges")
        dropped(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
