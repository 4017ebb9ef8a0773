import numpy as np
import xxhash
from loomgraph.llm import simhash
from loomgraph.llm.components import components


def plain_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    name = {i: i for i in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = name[i], name[j]
                if a != b:
                    name = {k: (b if v == a else v) for k, v in name.items()}
    least = {}
    for k, v in name.items():
        if ids[k] is not None:
            least[v] = min(least.get(v, ids[k]), ids[k])
    return [least.get(name[k]) for k in range(len(ids))]


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in simhash.op4_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids, fps = [r["doc_id"] for r in docs], [plain_fingerprint(r["text"]) for r in docs]
    for i, f, c in zip(ids, fps, plain_components(ids, fps)):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == c


def test_links_of_clusters(spark):
    """Tight clusters, chains and singletons, with small and large groups dealt out in cells."""
    r = np.random.default_rng(3)
    fps = set()
    for _ in range(12):
        x = int(r.integers(0, 2**63))
        for _ in range(60):
            x ^= 1 << int(r.integers(0, 64))
            if r.random() < 0.3:
                x ^= 1 << int(r.integers(0, 64)) | 1 << int(r.integers(0, 64)) | 1 << int(r.integers(0, 64))
            fps.add(x)
    fps = sorted(fps) + [0, 3]
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    reps = spark.createDataFrame(rows, "rep long, fp long")
    want = plain_components(list(range(len(fps))), fps)
    for rows_of_a_group in (20_000, 20):
        found = {r["node"]: r["component"] for r in components(simhash.links(reps, group_rows=rows_of_a_group)).collect()}
        assert [found.get(k, k) for k in range(len(fps))] == want


def test_edges(odd_docs, no_docs):
    got = simhash.near_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == 0 and by[4]["component_id"] == 2
    assert by[6]["component_id"] == 5 and by[7]["component_id"] == 7 and by[None]["component_id"] is None
    assert simhash.near_groups(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, **{200 + k: 200 for k in range(50)}} or got == {**{k: 0 for k in range(1, 41)}, 101: 100, **{200 + k: 200 for k in range(1, 50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_group_gives_a_forest():
    """Whatever the size of a group: at most one edge less than rows, and the components of all links."""
    r = np.random.default_rng(8)
    for n in (2, 47, 48, 49, 120):
        fps = np.array([int(r.integers(0, 2**63))], np.uint64) ^ (np.uint64(1) << r.integers(0, 3, n).astype(np.uint64))
        u, v = simhash.group_links(np.zeros(n, int), fps[:, None], np.arange(n), 4, simhash.references())
        assert len(u) == n - 1 and len({*u.tolist(), *v.tolist()}) == n
    group = np.repeat(np.arange(40), r.integers(1, 70, 40))
    fps = np.array([int(x) for x in r.integers(0, 2**12, len(group))], np.uint64)
    u, v = simhash.group_links(group, fps[:, None], np.arange(len(group)), 2, simhash.references())
    want = []
    for g in range(40):
        at = np.flatnonzero(group == g)
        want += [at[x] for x in plain_components(list(range(len(at))), [int(x) for x in fps[at]], 2)]
    name = {i: i for i in range(len(group))}
    for a, b in zip(u.tolist(), v.tolist()):
        assert group[a] == group[b]
        x, y = sorted((name[a], name[b]))
        name = {k: (x if c == y else c) for k, c in name.items()}
    assert [name[i] for i in range(len(group))] == want and len(u) == len(group) - len(set(want))


def test_components_of_hot_stars(spark, monkeypatch):
    from loomgraph.llm import components as C

    monkeypatch.setattr(C, "HOT", 3)
    monkeypatch.setattr(C, "SHARE", 10)
    edges = [(k, 5_000) for k in range(1, 400)] + [(900 + k, 901 + k) for k in range(30)] + [(930, 399)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: c for n, c in got.items() if n != 1} == dict.fromkeys([*range(2, 400), *range(900, 931), 5_000], 1)
