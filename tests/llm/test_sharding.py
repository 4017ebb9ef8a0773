import zlib

import numpy as np
from loomgraph.llm import sharding


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sharding.op10_sharding(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(text)
    shards = {}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(shards) == set(range(40))
    loads = [sum(n for _, n in s) for s in shards.values()]
    assert max(loads) - min(loads) < 0.05 * np.mean(loads)
    assert all(sorted(k for k, _ in s) == list(range(len(s))) for s in shards.values())


def test_map_versions(spark, tmp_path):
    r = np.random.default_rng(0)
    w = r.integers(1, 1000, 512)
    one = sharding.SlotMap.balanced(w, 8)
    two = one.rebalanced(w, shards=9)
    moved = [s for s, (a, b) in enumerate(zip(one.shard_of, two.shard_of)) if a != b]
    assert two.version == 2 and {two.shard_of[s] for s in moved} == {8} and len(moved) < 512 / 9 * 1.5
    load = np.bincount(two.shard_of, weights=w, minlength=9)
    assert load.max() < 1.05 * load.mean()
    path = f"file://{tmp_path}/maps"
    one.store(spark, path)
    two.store(spark, path)
    assert sharding.SlotMap.load(spark, path, 1) == one and sharding.SlotMap.load(spark, path, 2) == two == sharding.SlotMap.load(spark, path)


def test_a_later_run_edits_the_query_s_map(spark):
    """The map that the query stored is loaded by its path; a 41st shard takes rows, and no other one does."""
    sf = "/root/testdata/sf0.01"
    was = {r["doc_id"]: r for r in sharding.op10_sharding(spark, sf).collect()}
    path = next(iter(was.values()))["map_path"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, now = sharding.resharded(docs, path, 41)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert now.version == 2 and sharding.SlotMap.load(spark, path) == now and set(got) == set(was)
    moved = [d for d in got if got[d]["shard"] != was[d]["shard"]]
    assert moved and {got[d]["shard"] for d in moved} == {40} and all(got[d]["vslot"] == was[d]["vslot"] for d in got)
    load = np.bincount([r["shard"] for r in got.values()], weights=[r["size"] for r in got.values()], minlength=41)
    assert load[40] > 0.7 * load.mean()


def test_edges(odd_docs, no_docs):
    rows = sharding.sharded(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    for k in range(3):
        mine = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert mine == list(range(len(mine)))
    assert sharding.sharded(no_docs, 3).count() == 0
