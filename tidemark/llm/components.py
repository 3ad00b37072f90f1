"""Connected components of a graph given as a DataFrame of edges, by alternating large and small stars.

Every round is two aggregations and two joins over edges; nothing is collected but two numbers that tell whether the
edges changed. Centres of a large part of all edges are joined by broadcast, so that no task gets all edges of one. Rounds are written to the shared folder, so a lost executor costs a task, not the rounds before.

Defined results: edges that repeat count once; edges from a node to itself and edges with a null end are ignored; nodes without an edge have no
row; an empty table gives an empty result; columns other than u and v are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import hot_join, written

LEAST_HOT = 500


def _star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """edges (u, v), u > v."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = hot_join(both, least, "u", "n", 2 * n_edges, LEAST_HOT)
    moved = joined.where(F.col("v") > F.col("u") if large else F.col("v") < F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", "m"))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has an edge, with the least node it is connected to. edges: (u, v), any order."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("e")).where("e").drop("e").distinct(), "edges")
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while mark[0]:
        large = written(_star(now, mark[0], True), "stars")
        now = written(_star(large, mark[0], False), "stars")
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == tuple(was):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()).distinct()
