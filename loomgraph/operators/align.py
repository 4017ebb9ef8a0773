"""Alignment of topics: by the cosine similarity of their vectors, or by the words of their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.stored import stored

#: Query vectors that one pass over the index holds in memory, and vectors compared with each other at once.
BLOCK, SIDE = 20_000, 1_000


def _matrix(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def nearest(queries: DataFrame, index: DataFrame, key: str, vector: str) -> DataFrame:
    """left (query), right (its nearest other vector), score: exact, as blocks of queries against all rows.

    Each pass broadcasts at most BLOCK queries and keeps one candidate a query and task, so the result of
    a pass is small and no pairs are ever rows. Of equals the least key wins."""
    out = None
    total = queries.filter(F.col(vector).isNotNull()).count()
    blocks = max(1, -(-total // BLOCK))
    for k in range(blocks):
        part = queries.filter((F.pmod(F.xxhash64(key), F.lit(blocks)) == k) & F.col(vector).isNotNull()).select(key, vector).toPandas()
        if not len(part):
            continue
        shared = index.sparkSession.sparkContext.broadcast((part[key].to_numpy(), _matrix(part[vector])))

        def of(batches, shared=shared):
            ids, q = shared.value
            top, who = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            for b in batches:
                b = b.sort_values(key)
                for at in range(0, len(b), SIDE):  # a task holds SIDE x SIDE scores and one candidate a query
                    own = b[key].to_numpy()[at : at + SIDE]
                    m = _matrix(b[vector].iloc[at : at + SIDE]).T
                    for lo in range(0, len(ids), SIDE):
                        mine = slice(lo, lo + SIDE)
                        score = np.round(q[mine] @ m, 9)
                        score[ids[mine, None] == own[None, :]] = -np.inf
                        best = score.argmax(axis=1)
                        got, by = score[np.arange(len(best)), best], own[best]
                        better = (got > top[mine]) | ((got == top[mine]) & np.isfinite(got) & (by < who[mine]))
                        top[mine], who[mine] = np.where(better, got, top[mine]), np.where(better, by, who[mine])
            keep = np.isfinite(top)
            yield pd.DataFrame({"left": ids[keep], "right": who[keep], "score": top[keep]})

        rows = index.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(of, "left long, right long, score double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return index.sparkSession.createDataFrame([], "left long, right long, score double")
    best = out.groupBy("left").agg(F.max(F.struct("score", (-F.col("right")).alias("r"))).alias("b"))
    return best.select("left", (-F.col("b.r")).alias("right"), F.col("b.score").alias("score"))


def words(name) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _rare_first(sides: DataFrame, least: float) -> DataFrame:
    """(side, topic, words) -> side, topic, word: of each topic's words, rarest first, as many as one of a similar one
    must share. Of n words at least least * n are common to both, so not all of the others can be the rarest n - that + 1."""
    each = sides.select("side", "topic", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    listed = each.join(often, "word").groupBy("side", "topic").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("by"), F.first("n").alias("n"))
    needed = F.greatest(F.ceil(F.col("n") * F.lit(least) - 1e-9), F.lit(1)).cast("int")
    return listed.select("side", "topic", F.explode(F.slice("by", 1, F.greatest(F.col("n") - needed + 1, F.lit(0)))).alias("x")).select("side", "topic", "x.word")


def compared(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(topic) and (topic) -> left, right, score: topics that are each other's best match, by the Jaccard similarity
    of their words, of at least `least`; all others alone, with a null on the other side.

    Topics meet on their rare words only, which loses no match: a word that most topics have joins nothing unless
    they have no other. Of equals the least topic wins; null topics are left out."""
    side = lambda d, n: d.select(F.lit(n).alias("side"), "topic").filter("topic is not null").distinct().withColumn("words", words(F.col("topic")))
    both = stored(side(left, "left").unionByName(side(right, "right")))
    of = lambda d, n, *more: d.filter(F.col("side") == n).select(F.col("topic").alias(n), *more)
    a, b = (of(both, n, F.col("words").alias(f"{n}_words")) for n in ("left", "right"))
    rare = stored(_rare_first(both, least))
    met = of(rare, "left", "word").join(of(rare, "right", "word"), "word").select("left", "right").distinct()
    n, m = F.size("left_words"), F.size("right_words")
    met = met.join(a, "left").join(b, "right").filter((F.least(n, m) >= F.greatest(n, m) * F.lit(least) - 1e-9))
    common = F.size(F.array_intersect("left_words", "right_words"))
    scored = stored(met.select("left", "right", (common / (n + m - common)).alias("score")).filter(F.col("score") >= least))
    best = lambda k, o: scored.groupBy(k).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(o).alias("o"))).alias("b")).select(F.col(k), F.col("b.o").alias(o), (-F.col("b.s")).alias("score"))
    pairs = stored(best("left", "right").join(best("right", "left").drop("score"), ["left", "right"]).select("left", "right", "score"))
    alone = lambda d, n: d.select(n).join(pairs, n, "left_anti")  # noqa: E731  joined as nulls they would be one key
    return pairs.unionByName(alone(a, "left"), allowMissingColumns=True).unionByName(alone(b, "right"), allowMissingColumns=True)
