"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

Fingerprints at most `radius` bits apart leave at least two of radius + 2 bit blocks alike, so linked
fingerprints meet in at least one group that shares a pair of blocks. In a group the Hamming distances
of all its fingerprints to fixed reference fingerprints are computed once. By the triangle inequality
a pair whose distances to any reference differ by more than the radius is no link: those pairs are
discarded by the largest coordinate difference of their rows in the table, the survivors are verified.
A group gives a spanning forest of its links, never all its pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table, written
from loomgraph.llm.components import components

BITS, RADIUS, REFERENCES = 64, 4, 16
#: Rows of one group that a task compares; larger groups are dealt out in pairs of chunks.
GROUP_ROWS = 20_000
#: Groups up to this size are compared side by side, larger ones by growing components; the links found are the same.
SMALL = 48


def fingerprint(text: str | bytes | None, width: int = 4) -> int:
    """SimHash over the width-word shingles of a whole text: unsigned, 0 for no words or null.

    Shingles are hashed by XXH64 (seed 42); a bit is 1 if it is set in over half of the hashes.
    ASCII letters are lower-cased; fewer words than the width make one shingle."""
    import xxhash

    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    votes, step = np.zeros(BITS, np.int64), 65536
    for at in range(0, len(starts), step):
        got = np.array([h(joined[s:e], 42) for s, e in zip(starts[at : at + step], ends[at : at + step])], np.uint64)
        votes += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp: the fingerprint's 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def of(batches):
        for b in batches:
            got = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fp long")


def references(n: int = REFERENCES, words: int = 1) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64 - 1, (n, words), dtype=np.uint64, endpoint=True)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; fingerprints are rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


def unlike_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bytes, row by row, of the same rows."""
    return (np.ascontiguousarray(a).view(np.uint8) != np.ascontiguousarray(b).view(np.uint8)).sum(axis=1, dtype=np.int16)


def distance_table(fps: np.ndarray, refs: np.ndarray, of=distance) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one column a reference."""
    return np.stack([of(fps, r[None, :]) for r in refs], axis=1)


def _near(fps, dist, i, j, radius, of=distance):
    """Of the pairs (i, j): discard by the largest coordinate difference, verify the survivors."""
    for a in range(0, dist.shape[1], 4):
        keep = (np.abs(dist[i, a : a + 4] - dist[j, a : a + 4]) <= radius).all(axis=1)
        i, j = i[keep], j[keep]
    keep = of(fps[i], fps[j]) <= radius
    return i[keep], j[keep]


def _grow(fps, dist, at, radius, of=distance):
    """Spanning forest of the links among the rows `at` of a large group."""
    left, out_i, out_j = at[np.argsort(dist[at, 0], kind="stable")], [], []
    front = left[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
            continue
        x, front = front[:1], front[1:]
        lo, hi = np.searchsorted(dist[left, 0], [dist[x[0], 0] - radius, dist[x[0], 0] + radius + 1])
        i, j = _near(fps, dist, np.repeat(x, hi - lo), left[lo:hi], radius, of)
        if len(j):
            out_i.append(i)
            out_j.append(j)
            left = left[~np.isin(left, j, assume_unique=True)]
            front = np.concatenate((front, j))
    none = at[:0]
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the pairs (i, j) are joined: each row's root is the least row that it is connected to."""
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        np.minimum.at(root, high, low)
        while True:  # every row points to a root again
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def group_links(group: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int, refs: np.ndarray, of=distance):
    """Edges (id, id) that connect what is linked inside the groups; rows of a group are adjacent.

    A group of any size gives a forest: one edge less than it has rows, at most."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.append(start, len(group)))
    many = np.repeat(length > 1, length)
    fps, ids, length = fps[many], ids[many], length[length > 1]
    if not len(fps):
        return ids[:0], ids[:0]
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    dist = distance_table(fps, refs, of)
    end_of = np.repeat(start + length, length)
    small, root = np.flatnonzero(np.repeat(length <= SMALL, length)), np.arange(len(fps))
    for d in range(1, SMALL):  # rows d apart, in all small groups at once, if nothing connects them yet
        small = small[small + d < end_of[small]]
        if not len(small):
            break
        open_ = small[root[small] != root[small + d]]
        root = _joined(root, *_near(fps, dist, open_, open_ + d, radius, of))
    tied = np.flatnonzero(root != np.arange(len(root)))
    got = [(tied, root[tied])] + [_grow(fps, dist, np.arange(s, s + n), radius, of) for s, n in zip(start, length) if n > SMALL]
    i, j = (np.concatenate(x) for x in zip(*got))
    return ids[i], ids[j]


def _masks(radius: int) -> list[int]:
    """One mask for each pair of the radius + 2 blocks of bits."""
    cuts = [BITS * k // (radius + 2) for k in range(radius + 3)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(reps: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(rep, fp) of distinct fingerprints -> edges (u, v) whose components are those of all links."""
    pairs = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(_masks(radius))]
    rows = reps.select("rep", F.col("fp").alias("fp0"), F.explode(F.array(*pairs)).alias("x")).select("x.k", "x.part", F.lit(0).alias("cell"), "rep", "fp0")
    return group_edges(rows, 1, radius, references(), group_rows)


def group_edges(rows: DataFrame, words: int, radius: int, refs: np.ndarray, group_rows: int, apart=distance) -> DataFrame:
    """Rows (k, part, cell, rep, fp0, ...) -> edges that connect what is linked in each group (k, part)."""
    fp = [f"fp{n}" for n in range(words)]
    sizes = rows.groupBy("k", "part").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
    hot = written(sizes, "large")
    if not hot.isEmpty():
        # every pair of chunks of a large group meets in one cell; a chunk has half of group_rows or so
        chunks = F.ceil(F.col("n") / (group_rows / 2)).cast("int")
        own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
        split = rows.join(hot, ["k", "part"]).withColumn("chunks", chunks).withColumn("own", own)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cell = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other") + 1
        split = split.select("k", "part", cell.alias("cell"), "rep", *fp)
        rows = rows.join(hot.select("k", "part"), ["k", "part"], "left_anti").select(split.columns).unionAll(split)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # a few MB of numbers
    rows = rows.repartition("k", "part", "cell").sortWithinPartitions("k", "part", "cell")

    def of(batches):
        held = None
        for b in (*batches, None):
            new = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1) if b is not None else np.zeros((0, 4 + words), np.int64)
            held = new if held is None else np.concatenate((held, new))
            if not len(held):
                continue
            last = (held[:, :3] == held[-1, :3]).all(axis=1) if b is not None else np.zeros(len(held), bool)
            done, held = held[~last], held[last]
            if not len(done):
                continue
            group = np.concatenate(([0], np.cumsum((done[1:, :3] != done[:-1, :3]).any(axis=1))))
            u, v = group_links(group, np.ascontiguousarray(done[:, 4:]).view(np.uint64), done[:, 3], radius, refs, apart)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(of, "u long, v long")


def near_groups(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach from it) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one node,
    named by their least doc_id. A null doc_id is never a name: a group of such rows only has a null
    component. Repeated rows come out repeated; other columns are not read; no rows give no rows."""
    fps = written(fingerprints(docs, width), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = components(links(reps.filter("rep is not null"), radius))
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("rep_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("rep_fp"), "left").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents; see near_groups()."""
    got = near_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
