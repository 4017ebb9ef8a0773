import re

from loomgraph.llm import mixing
from loomgraph.llm._common import n_words
from pyspark.sql import functions as F


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by giving out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in names if target[s] < most * sizes[s] - 1e-9]
        if not open_:
            break
        part = left / sum(w[s] for s in open_)
        left = 0.0
        for s in open_:
            new = target[s] + part * w[s]
            left += max(0.0, new - most * sizes[s])
            target[s] = min(new, most * sizes[s])
    return target


def fair_queue(rows, turn, budget=None, most=3, by_pass=False):
    """Words taken of each doc_id (by_pass: of each of its passes): all passes of all sources in one list by finish time, those that are not over by
    the time of the cut in packets, from the front until the budget is used up. rows: (doc_id, source, size); turn:
    the shuffle's number of (doc_id, size)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = water(sizes)
    budget = round(sum(target.values())) if budget is None else budget
    end = budget / sum(target.values())
    slot = lambda t: ((t % 2**64) >> 32) % mixing.SLOTS
    line = []
    for s in sizes:
        mine = sorted((slot(turn[d, n]), turn[d, n], d, n) for d, x, n in rows if x == s)
        before, packet = 0, max(1, int(target[s] // mixing.PACKETS))
        for p in range(most):
            for k, (_, t, d, n) in enumerate(mine):
                if n and before + n <= end * target[s]:
                    line.append(((before + n) / target[s], t, d, p, k, -1, n))
                else:
                    line += [((before + at + min(packet, n - at)) / target[s], t, d, p, k, at // packet, min(packet, n - at)) for at in range(0, n, packet)]
                before += n
    taken, left = {}, budget
    for *_, d, p, _, _, n in sorted(line):
        if by_pass:
            given = taken.setdefault(d, {})
            given[p] = given.get(p, 0) + min(n, left)
        else:
            taken[d] = taken.get(d, 0) + min(n, left)
        left -= min(n, left)
    return target, sizes, taken


def held_to_brute_force(got, rows, turn, budget=None):
    target, sizes, taken = fair_queue(rows, turn, budget)
    assert len(got) == len(rows)
    own = {}
    for r in got:
        own[r["doc_id"]] = own.get(r["doc_id"], 0) + r["taken"]
    assert own == {d: taken.get(d, 0) for d, _, _ in rows}
    source = {d: s for d, s, _ in rows}
    given = {}
    for r in got:
        s = source[r["doc_id"]]
        given[s] = given.get(s, 0) + r["taken"]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
    return target, given


def turns(spark, rows):
    d = spark.createDataFrame([(d, n) for d, _, n in rows], "doc_id long, size long")
    return {(r["doc_id"], r["size"]): r["turn"] for r in d.withColumn("turn", F.xxhash64(F.lit(17), "doc_id", "size")).collect()}


ROWS = [(i, s, 1 + (i * 7919) % 200) for i, s in enumerate(["a"] * 300 + ["b"] * 5 + [None] * 20 + ["c"] * 40 + ["é"] * 9)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, size long")
    whole = lambda d: mixing.mix(d, keep_untaken=True).groupBy("source", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    got = whole(docs)
    target, given = held_to_brute_force(got, ROWS, turns(spark, ROWS))
    assert all(abs(given[s] - target[s]) <= 2 for s in target) and sum(given.values()) == sum(n for _, _, n in ROWS)
    assert sorted(map(str, whole(docs.repartition(7)))) == sorted(map(str, got))
    few = mixing.mix(docs, budget=777).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()
    assert {r["doc_id"]: r["taken"] for r in few} == {d: n for d, n in fair_queue(ROWS, turns(spark, ROWS), 777)[2].items() if n}


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = mixing.op1_mixing(spark, sf).collect()
    target, given = held_to_brute_force(got, rows, turns(spark, rows))
    assert all(abs(given.get(s, 0) - target[s]) <= 2 + target[s] / 500 for s in target)


def test_the_merge_is_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, size long")
    p = mixing.mix(docs, keep_untaken=True)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in plan and "finish" in plan


def test_order_of_finish(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(200)], "doc_id long, source string, size long")
    whole = mixing.mix(docs).collect()
    cut = mixing.mix(docs, budget=777).collect()
    assert sum(r["taken"] for r in cut) == 777 and sum(r["taken"] for r in whole) == 2000
    order = sorted(whole, key=lambda r: (r["finish"], r["turn"], r["doc_id"], r["pass"]))
    assert {(r["doc_id"], r["pass"]) for r in cut} <= {(r["doc_id"], r["pass"]) for r in order[:80]}
    assert mixing.mix(docs, budget=10**9).agg(F.sum("taken")).first()[0] == 2000


def test_edges(spark, odd_docs, no_docs):
    size = lambda d: d.withColumn("size", n_words(F.col("text")))
    got = mixing.mix(size(odd_docs), keep_untaken=True)
    assert got.select("doc_id").distinct().count() == 9
    assert got.filter("doc_id in (2, 3, 4)").agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix(size(no_docs), keep_untaken=True).count() == 0 and mixing.mix(size(no_docs)).count() == 0
    empty = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(empty, keep_untaken=True).collect()) == [(1, 0), (2, 0)]
    assert [r[0] for r in odd_docs.filter("doc_id in (3, 4, 1)").orderBy("doc_id").select(n_words(F.col("text"))).collect()] == [84, 0, 0]
