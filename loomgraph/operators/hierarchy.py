"""Class hierarchies: transitive closure, roots, nearest mapped ancestor, and filters over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.stored import counted, stored

#: Edges of a hierarchy that goes to every executor; larger ones are closed by joins.
BROADCAST_EDGES = 20_000


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(child, parent) -> (child, ancestor, depth), with the least depth of each pair, whatever the depth.

    Up to BROADCAST_EDGES edges each class walks up by itself, as rows of one pass. In larger hierarchies paths
    double in length every round, so depth d takes log2(d) joins. Cycles end where nothing is new. reflexive adds
    every class as its own ancestor at depth 0."""
    edges, n = counted(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
    now = _walked(edges) if n <= BROADCAST_EDGES else _doubled(edges)
    if reflexive:
        nodes = edges.select(F.col("child").alias("child")).union(edges.select("parent")).distinct()
        now = now.unionByName(nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth")))
    return now


def _walked(edges: DataFrame) -> DataFrame:
    up: dict = {}
    for r in edges.collect():  # a checked number of rows
        up.setdefault(r["child"], []).append(r["parent"])
    shared = edges.sparkSession.sparkContext.broadcast(up)
    kind = edges.schema["child"].dataType.simpleString()

    def of(batches):
        up = shared.value
        for b in batches:
            rows = []
            for c in b["child"]:
                seen, front, depth = {c}, [c], 0
                while front:
                    depth += 1
                    front = [p for p in dict.fromkeys(p for x in front for p in up.get(x, ())) if p not in seen]
                    seen.update(front)
                    rows += [(c, p, depth) for p in front]
            yield pd.DataFrame(rows, columns=["child", "ancestor", "depth"])

    return edges.select("child").distinct().mapInPandas(of, f"child {kind}, ancestor {kind}, depth int")


def _doubled(edges: DataFrame) -> DataFrame:
    """By joins of what is known with itself. No pair is new in a round: no longer way is there either, as a way
    of any length has a beginning that is as long as the round's."""
    now, n = counted(edges.filter("child != parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    while n:
        step = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child"))
        step = step.select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")).filter("child != ancestor")
        now, m = counted(now.unionByName(step).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        if m == n:
            break
        n = m
    return now


def roots(edges: DataFrame) -> DataFrame:
    """Classes that are a parent and have none."""
    up = edges.select(F.col("parent").alias("class")).distinct()
    return up.join(edges.select(F.col("child").alias("class")), "class", "left_anti")


def nearest_mapped(closed: DataFrame, mapped: DataFrame) -> DataFrame:
    """(class, mapping) of the nearest ancestor that mapped (class, mapping) has; ties by mapping."""
    got = closed.join(mapped, closed["ancestor"] == mapped["class"]).select("child", "depth", "mapping")
    return got.groupBy("child").agg(F.min(F.struct("depth", "mapping")).alias("m")).select("child", F.col("m.mapping").alias("mapping"))


def in_class(rows: DataFrame, column: str, closed: DataFrame, ancestor: str) -> DataFrame:
    """Rows whose class is `ancestor` or under it; a row counts once however many paths lead there."""
    under = closed.filter(F.col("ancestor") == ancestor).select(F.col("child").alias(column)).distinct()
    return rows.join(under, column, "left_semi")


def is_instance(facts: DataFrame, closed: DataFrame, allowed: list[str]) -> DataFrame:
    """(item, class) -> items that are instances of an allowed class or of one under it."""
    under = closed.filter(F.col("ancestor").isin(allowed)).select(F.col("child").alias("class")).distinct()
    return facts.join(under, "class", "left_semi").select("item").distinct()


def linked_list(first: DataFrame, following: DataFrame) -> DataFrame:
    """(owner, node) heads and (node, next) links -> (owner, node, seq): chains walked by pointer doubling.

    Each round knows twice as many nodes from their owner's head, so a chain takes log2(length) rounds; seq
    counts from 1. A chain that comes back to a node of its own ends there."""
    jump = stored(following.select(F.col("node"), F.col("next").alias("to"), F.lit(1).alias("steps")))
    reach, n = counted(first.select("owner", "node", F.lit(1).alias("seq")))
    while n:
        step = reach.join(jump, "node").select("owner", F.col("to").alias("node"), (F.col("seq") + F.col("steps")).alias("seq"))
        reach, m = counted(reach.unionByName(step).groupBy("owner", "node").agg(F.min("seq").alias("seq")))
        if m == n:
            return reach
        n = m
        twice = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node"))
        jump = stored(twice.select("a.node", "b.to", (F.col("a.steps") + F.col("b.steps")).alias("steps")))
    return reach
