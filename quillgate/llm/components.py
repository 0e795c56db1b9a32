"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.llm._store import drop, materialise

#: Edges of a partition between the steps of a round.
EDGES = 100_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", most: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges``; component is the smallest node.

    Alternates the large-star and small-star steps, so the rounds grow with the logarithm
    of the size; every round is cut as a table in the shared folder. Null ends and loops
    are dropped; an empty graph gives no rows. The steps are aggregates and equi-joins:
    a node with very many edges is pre-aggregated or split by the engine, never gathered.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v").distinct()
    e = materialise(e, "cc")
    mark = _mark(e)
    for _ in range(most):
        if not mark[0]:
            break
        # few edges are kept in few files, whatever the session's number of partitions
        before, e = e, materialise(_small_star(_large_star(e)).coalesce(mark[0] // EDGES + 1), "cc")
        drop(before)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
