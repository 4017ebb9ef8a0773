"""Mix sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, repeated pass after pass. A queued pass gets the
virtual finish time `cumulative words of the source / target of the source`; a pass that is still in service
when the budget is used up is served in packets, of about a thousandth of its source's target, with finish
times of their own. All are range-sorted by their finish times, words are summed up along this order, and the
order is truncated at the total budget: the packet in service there is cut. As the targets add up to the
budget, every source then has given its target but for a packet or so.

Cumulative sums are never made by one task: a source's documents are dealt into hash slots in shuffle
order, the merged passes into ranges of finish times; slots and ranges are summed first, and only those
sums are accumulated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import n_words, table, written

SLOTS = 1024
MAX_PASSES = 3
#: Packets that a target is served in.
PACKETS = 1024


def source_targets(sizes: DataFrame, budget_share: float = 1.0, weights: tuple = (1, 2, 3), max_passes: int = MAX_PASSES) -> DataFrame:
    """skey, source, source_size -> plus target (double). One row a source.

    Sources in code point order, null last, take the weights in turn. A target stops at max_passes
    times the source's size and the excess is shared again by weight: the fixed point is
    min(cap, level * weight), and the level follows from running sums over cap / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", max_passes * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        t.withColumn("total", F.sum("source_size").over(every).cast("double") * budget_share)
        .withColumn("capped", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first source, by cap / weight, that its level does not fill sets the level of all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    t = t.withColumn("cut", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level"))).alias("x")).over(every))
    level = F.coalesce(F.col("cut")["level"], F.lit(float("inf")))
    return t.withColumn("target", F.when(F.col("cap") <= 0, 0.0).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select("skey", "source", "source_size", "target")


def queued(docs: DataFrame, size: str = "size", seed: int = 17, budget_share: float = 1.0, weights: tuple = (1, 2, 3), max_passes: int = MAX_PASSES, slots: int = SLOTS) -> DataFrame:
    """One row a document, with its place in its source's queue.

    docs: doc_id, source and the column `size` (words; null counts as 0); other columns are not read.
    Adds source_size, target, before (words of its source ahead of it in each pass), rn and slot.
    Repeated rows are queued one by one; a null source is a source of its own; no rows give no rows."""
    d = docs.select("doc_id", "source", F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size))
    d = d.withColumn("skey", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    d = d.withColumn("turn", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(size)))
    d = d.withColumn("slot", F.shiftrightunsigned(F.col("turn"), 32) % slots)
    d = written(d, "sized")  # texts are read once
    sums = d.groupBy("skey", "slot").agg(F.sum(size).alias("slot_size"), F.first("source").alias("source"))
    ahead = Window.partitionBy("skey").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("slot_before", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)))
    whole = d.groupBy("skey").agg(F.sum(size).alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(whole, budget_share, weights, max_passes)
    places = sums.join(targets.select("skey", "source_size", "target"), "skey").select("skey", "slot", "slot_before", "source_size", "target")
    d = d.join(places, ["skey", "slot"])
    here = Window.partitionBy("skey", "slot").orderBy("turn", "doc_id", size)
    return (
        d.withColumn("rn", F.row_number().over(here))
        .withColumn("before", F.col("slot_before") + F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size))
        .drop("slot_before")
    )


def mix(docs: DataFrame, size: str = "size", budget: int | None = None, max_passes: int = MAX_PASSES, keep_untaken: bool = False, **how) -> DataFrame:
    """The mix: one row for each pass of a document that the mix takes.

    Adds pass (from 0), finish (virtual: the source has given its target at 1) and taken (words). budget: the
    words that the merged queues give, at most and by default what the targets hold together. keep_untaken also
    keeps documents that give nothing (pass null, taken 0)."""
    q = queued(docs, size, max_passes=max_passes, **how)
    t = q.filter("target > 0").groupBy("skey").agg(F.first("target").alias("target")).withColumn("packet", _packet(F.col("target")))
    held, slowest = t.agg(F.sum("target"), F.max(F.col("packet") / F.col("target"))).first()
    held, slowest = held or 0.0, slowest or 0.0
    budget = round(held) if budget is None else min(int(budget), round(held))
    end = budget / held if held else 0.0  # the virtual time of the cut, but for a packet of each source
    target, whole, packet = F.col("target"), F.col(size), _packet(F.col("target"))
    upto = F.lit(end + slowest) * target  # what starts here or later finishes after all that the budget holds
    rounds = F.when((whole > 0) & (target > 0), F.least(F.lit(max_passes), F.ceil((upto - F.col("before")) / F.col("source_size")))).otherwise(0)
    passes = F.when(rounds > 0, F.sequence(F.lit(0), rounds.cast("int") - 1))
    p = q.withColumn("pass", F.explode_outer(passes)).withColumn("start", F.col("pass") * F.col("source_size") + F.col("before"))
    done = F.coalesce(F.col("start") + whole <= end * target, F.lit(True))
    count = F.least(F.ceil(whole / packet), F.ceil((upto - F.col("start")) / packet))
    p = p.withColumn("packet", F.explode(F.when(done, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))))
    at = F.greatest(F.col("packet"), F.lit(0)) * packet
    p = p.withColumn("words", F.when(F.col("packet") < 0, whole).otherwise(F.least(packet, whole - at)))
    p = p.withColumn("finish", (F.col("start") + at + F.col("words")) / target)
    p = written(p.drop("start"), "passes")
    served = truncated(p.filter("pass is not null"), budget)
    keys = ["skey", *(c for c in q.columns if c != "skey"), "pass"]
    parts = served.filter("packet >= 0").groupBy(*keys).agg(F.max("finish").alias("finish"), F.sum("taken").alias("taken"))
    out = served.filter("packet < 0").select(*keys, "finish", "taken").unionByName(parts)
    if not keep_untaken:
        return out.filter("taken > 0").drop("skey")
    # a document whose first pass gives nothing gives nothing in the later ones
    out = out.filter("taken > 0 or pass = 0").unionByName(p.filter("pass is null").select(*keys, "finish", F.lit(0).cast("long").alias("taken")))
    none = F.col("taken") == 0
    return out.withColumn("pass", F.when(~none, F.col("pass"))).withColumn("finish", F.when(~none, F.col("finish"))).drop("skey")


def _packet(target):
    return F.greatest(F.lit(1), F.floor(target / PACKETS)).cast("long")


ORDER = ["finish", "turn", "doc_id", "pass", "rn", "packet"]


def truncated(p: DataFrame, budget: int) -> DataFrame:
    """Adds taken: the words of each row inside of the first `budget` words in the order of finish times.

    The rows are range-sorted and stored; each range is summed, and a row's place in the order is the sum of
    the ranges before its own and of the rows before it there. Ties go by turn, doc_id, pass, rn and packet."""
    p = p.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("range", F.spark_partition_id())
    p = written(p, "merged")
    sums = p.groupBy("range").agg(F.sum("words").alias("range_size"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("upto", F.sum("words").over(here)).join(F.broadcast(sums), "range")
    left = F.lit(int(budget)) - (F.col("ahead") + F.col("upto") - F.col("words"))
    return p.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")).drop("range", "upto", "ahead")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; see mix().

    The mix's budget is the words of all documents, which is what the targets hold together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mix(docs, keep_untaken=True)
    keys = ["source", "slot", "rn", "doc_id", "size", "source_size", "target"]
    return taken.groupBy(*keys).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
