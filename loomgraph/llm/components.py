"""Connected components of a distributed edge list, labelled by their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import written

MAX_ROUNDS = 60
#: Edges of a node that has more than HOT of them, and more than one in SHARE of all, don't go to one task.
HOT, SHARE = 1_000, 500


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(e: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """e (u, v) with m of least (c, m, n) at u = c, where the n sum up to total.

    A star's centre may have any share of all edges. Nodes that have more than one in SHARE of them are less than
    SHARE, so they are broadcast and their edges go anywhere: under the number of their other end."""
    often = F.col("n") > max(HOT, total // SHARE)
    hot = F.broadcast(least.filter(often).select(F.col("c").alias("hot"), F.col("m").alias("hot_m")))
    e = e.join(hot, F.col("u") == F.col("hot"), "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("u")).otherwise(F.col("v")))
    rest = least.filter(~often).select("c", "m")
    return e.join(rest, F.col("at") == F.col("c"), "left").select("u", "v", F.coalesce("hot_m", "m").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    e = _both(edges)
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"), "n")
    e = _with_least(e.filter("v > u"), least, 2 * total)
    return e.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), "m", "n")
    e = _with_least(e, least, total)
    return e.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, to a node that has none."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    between = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.unionAll(between).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) undirected -> (node, component): each node that has an edge, with the least node it reaches.

    Alternates large-star and small-star steps, every one written to the shared folder, until the
    edges are stars. Self-loops count as nothing; no edges give no rows."""
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        total = now.count()  # of the files' footers
        wide = written(_large_star(now, total).distinct(), "edges")
        now = written(_small_star(wide, total).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
