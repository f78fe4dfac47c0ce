"""Connected components of an edge table by large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, which halves
distances; the number of steps is logarithmic in practice. Steps are groupings
with a map-side minimum and equi-joins, so a node with very many edges neither
meets in one task nor goes to the driver; every step's edges are written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), component being the
    smallest node that it reaches."""
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        # the steps only ever lower ends: equal counts and sums mean that nothing moved
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
