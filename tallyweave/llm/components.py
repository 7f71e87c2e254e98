"""Connected components as DataFrames, by alternating large-star and small-star steps.

Each step is a few key-partitioned aggregations and joins over the edges; nothing is gathered on the
driver but two numbers that tell whether the edges still change. Lineage is cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for each node of `edges` (two columns of ids, any direction): the smallest id it reaches.

    Loops and repeated edges are allowed; nulls are dropped. Nodes without edges aren't returned.
    The number of rounds is logarithmic in practice; a star or chain of any size needs no task of its own.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "edges")
        changed = _state(after)
        discard(now)
        now, before, state = after, state, changed
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
