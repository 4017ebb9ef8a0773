"""MinHash fingerprints of documents: universal hash permutations over word shingles, in numpy.

A batch of texts is hashed as one byte array: words by a polynomial over prefix sums, shingles by a
mix of their words' hashes, then every permutation is one multiply-add over all shingles of the batch
and one minimum a text. Signatures cut into bands are joined in Spark and the candidates' Jaccard
similarity is verified on the shingles themselves (copy_groups)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table, written
from loomgraph.llm.components import components
from loomgraph.llm.simhash import GROUP_ROWS, fingerprint, group_edges, links, references, unlike_bytes

PERMUTATIONS, WIDTH, BANDS, THRESHOLD = 128, 5, 32, 0.8
#: Shingles hashed at once: a permutation's values stay in the cache.
BLOCK = 32_768

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << int(n).bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutations(n: int = PERMUTATIONS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """x -> a * x + b modulo 2**32 with a odd: permutations of the 32-bit shingle hashes."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def shingle_hashes(texts: list[bytes], width: int = WIDTH, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """32-bit (wide: 64-bit) hashes of all shingles of all texts, and each text's first one (len + 1 numbers).

    ASCII letters are lower-cased. A text of fewer words is one shingle; one without words has none."""
    raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    gap = _GAP[raw]
    if not len(raw):
        return np.zeros(0, np.uint64 if wide else np.uint32), np.zeros(len(texts) + 1, np.int64)
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[0::2], change[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, at)  # each text's first word
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    place = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(first[:-1] - place[:-1], count) + np.arange(place[-1])
    reach = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    total = np.zeros(len(begin), np.uint64)
    for k in range(width):
        factor = np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        term = _mix(padded[begin + k] + factor)
        total = total * np.uint64(0x100000001B3) + (term if k == 0 else np.where(reach > k, term, np.uint64(0)))
    return _mix(total) if wide else (_mix(total) >> np.uint64(32)).astype(np.uint32), place


def signatures(texts: list[bytes], width: int = WIDTH, perms=None) -> np.ndarray:
    """One row of minima a text; all ones for a text without words."""
    a, b = permutations() if perms is None else perms
    x, place = shingle_hashes(texts, width)
    out = np.full((len(texts), len(a)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(place))
    lo = 0
    while lo < len(full):  # whole texts up to BLOCK shingles; a longer text alone, in slices
        hi = max(lo + 1, int(np.searchsorted(place[full + 1], place[full[lo]] + BLOCK, side="right")))
        rows, s, e = full[lo:hi], place[full[lo]], place[full[hi - 1] + 1]
        for c in range(s, e, 4 * BLOCK):
            part = x[c : min(e, c + 4 * BLOCK)]
            cuts = np.maximum(place[rows] - c, 0) if len(rows) > 1 else np.zeros(1, np.int64)
            buf = np.empty_like(part)
            for k in range(len(a)):
                np.multiply(part, a[k], out=buf)
                buf += b[k]
                least = np.minimum.reduceat(buf, cuts) if len(cuts) > 1 else buf.min()
                out[rows, k] = np.minimum(out[rows, k], least)
        lo = hi
    return out


def as_fingerprint(signature: np.ndarray) -> str:
    """The low 16 bits of every minimum, as hex."""
    return signature.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row: an estimate of the Jaccard similarity."""
    return (a.astype(np.uint16) == b.astype(np.uint16)).mean(axis=-1)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, tail, doc_id, text), to be read in this order within a bucket: each document is
    followed by its successor in ascending order of doc_id, the last of all by the first.

    Documents are dealt into ranges of doc_id by its quantiles, so each text is shuffled once; the first
    text of each range is also sent, as tail = 1, to the range before. Null ids come last; repeated ids
    are ordered by text."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    d = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep").transform(docs.withColumn("x", F.col("doc_id").cast("double")))
    d = d.select(F.coalesce(F.col("b").cast("int"), F.lit(len(splits))).alias("bucket"), "doc_id", "text")
    least = d.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    order = Window.orderBy("bucket")  # one row a bucket
    least = least.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    least = least.withColumnRenamed("bucket", "from")
    first = d.join(F.broadcast(least), (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("least")))
    first = first.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    rows = d.withColumn("tail", F.lit(0)).select("bucket", "tail", "doc_id", "text").unionAll(first.select(F.col("to").alias("bucket"), F.lit(1).alias("tail"), "doc_id", "text"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "text")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts: doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (the low 16 bits of 128 minima), near_edited and near_next (shares of equal minima).

    A null text is empty; texts without words have one fingerprint, all ones. Equal texts have equal
    fingerprints. Rows are in the order of doc_id, null last, and text, so repeated rows are each other's next
    document; a single row is its own. Other columns aren't read; no rows give no rows."""
    bounded_batches(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches):
        """(doc_id, text, next text) in lists of about half a million characters."""
        held, out, size = None, [], 0
        for b in batches:
            for bucket, tail, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                text = text.as_py()
                if held is not None and held[0] == bucket:
                    out.append((held[1], held[2], text))
                    size += len(held[2]) + len(text)
                    if size > 500_000:
                        yield out
                        out, size = [], 0
                held = None if tail else (bucket, doc, text)
        if out:
            yield out

    def of(batches):
        for some in pairs(batches):
            edited = []
            for _, text, after in some:
                half = len(text) // 2
                edited.append((text[: len(text) - half] + after[:half]).encode())
            # a document's successor is the next one of the list, but where a list or a range ends
            own = [text.encode() for _, text, _ in some]
            after = [i for i in range(len(some)) if i + 1 == len(some) or some[i + 1][1] is not some[i][2]]
            s = signatures([*own, *edited, *(some[i][2].encode() for i in after)])
            n = len(some)
            s_own, s_edited, s_next = s[:n], s[n : 2 * n], np.roll(s[:n], -1, axis=0)
            s_next[after] = s[2 * n :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in some], pa.int64()),
                    pa.array([len(t) for _, t, _ in some], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([as_fingerprint(x) for x in s_own]),
                    pa.array([as_fingerprint(x) for x in s_edited]),
                    pa.array(likeness(s_own, s_edited)),
                    pa.array(likeness(s_own, s_next)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(table(spark, sf_dir, "documents")).mapInArrow(of, schema)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, same (digest of the whole text), signature (its minima as bytes) and fp (its SimHash) of every row."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "same", "signature", "fp"]

    def of(batches):
        for b in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in b.column(1)]
            lo, size = 0, 0
            for k, t in enumerate([*texts, None]):
                if t is None or size + len(t) > 1_000_000:
                    if k > lo:
                        s = signatures(texts[lo:k])
                        same = [hashlib.blake2b(x, digest_size=16).digest() for x in texts[lo:k]]
                        fp = np.array([fingerprint(x) for x in texts[lo:k]], np.uint64).view(np.int64)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k - lo), pa.array(same), pa.array([x.astype("<u4").tobytes() for x in s]), pa.array(fp)], names)
                    lo, size = k, 0
                size += len(t or b"")

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, same binary, signature binary, fp long")


#: Texts of which over this share of the minima differ are not compared: at a similarity of 0.8 that has a chance of about 1e-10.
UNLIKE = 58 / PERMUTATIONS
#: Bytes of text of one cluster that a task compares; larger clusters are dealt out in pairs of chunks of half of it.
CLUSTER_BYTES = 32 << 20


def linked(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that connect what has a Jaccard similarity of `threshold` or more: each component's spanning forest.

    The sets' elements are unique; intersections are counted through an index of who has an element."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    _, element, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(element, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    left, front, out_i, out_j = np.ones(len(sets), bool), [], [], []
    unseen = iter(range(len(sets)))
    while left.any():
        if front:
            x = front.pop()
        else:
            x = next(k for k in unseen if left[k])
            left[x] = False
        e = element[at[x] : at[x + 1]]
        e = e[n[e] > 1]
        m = n[e]
        common = np.bincount(owner[np.repeat(begin[e] - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(sets))
        got = np.flatnonzero(left & (common / np.maximum(size + size[x] - common, 1) >= threshold))
        left[got] = False
        front += got.tolist()
        out_i.append(np.full(len(got), x))
        out_j.append(got)
    return np.concatenate(out_i), np.concatenate(out_j)


def _candidates(classes: DataFrame, bands: int, group_rows: int) -> DataFrame:
    """(doc_id, signature) of different texts -> edges (u, v) that connect all texts that share a band and have enough minima alike."""
    words, rows_of_band = PERMUTATIONS // 8, PERMUTATIONS // bands
    fp = [f"fp{n}" for n in range(words)]

    def of(batches):
        for b in batches:
            if not len(b):
                continue
            s = np.stack([np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()])
            key = np.zeros((len(s), bands), np.uint64)
            for k in range(rows_of_band):
                key = _mix(key * _P + s[:, k::rows_of_band].astype(np.uint64) + np.uint64(1))
            low = np.ascontiguousarray(s.astype(np.uint8)).view(np.int64)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), parts, *(pa.array(np.ascontiguousarray(low[:, n])) for n in range(words))], ["rep", "parts", *fp])

    sketches = written(classes.mapInArrow(of, "rep long, parts array<long>, " + ", ".join(f"{x} long" for x in fp)), "sketches")
    keys = sketches.select("rep", F.posexplode("parts").alias("k", "part"))
    met = keys.join(keys.groupBy("k", "part").agg(F.count("*").alias("n")).filter("n > 1"), ["k", "part"], "left_semi")
    rows = met.join(sketches.drop("parts"), "rep").select("k", "part", F.lit(0).alias("cell"), "rep", *fp)
    return group_edges(rows, words, round(UNLIKE * PERMUTATIONS), references(1, words), group_rows, unlike_bytes)


def _alike(classes: DataFrame, group_rows: int) -> DataFrame:
    """(rep, fp) of different texts -> edges (u, v) that connect all whose SimHash fingerprints are op4's few bits apart."""
    first = written(classes.groupBy("fp").agg(F.min("rep").alias("first")), "alike")
    equal = classes.join(first.withColumnRenamed("fp", "own"), F.col("fp") == F.col("own")).filter("rep != first").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    return equal.unionAll(links(first.select(F.col("first").alias("rep"), "fp"), group_rows=group_rows))


def copy_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, group_rows: int = GROUP_ROWS, cluster_bytes: int = CLUSTER_BYTES) -> DataFrame:
    """doc_id and component_id of every row: groups connected by a Jaccard similarity of `threshold` or more between whole
    texts, as sets of WIDTH-word shingles, named by their least doc_id.

    SimHash fingerprints and MinHash signatures only propose: texts whose fingerprints are as near as op4 links them, and texts
    that share a band and most minima, make clusters, and in a cluster every text's whole set of shingles (64-bit hashes) is compared with all that it isn't connected to yet. A pair at 0.8 misses all of the 32 bands
    with a chance of 5e-8. Equal texts are one class, so are all without words; rows without a doc_id are left out;
    repeated rows come out repeated."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    empty = F.col("signature") == F.lit(b"\xff" * 4 * PERMUTATIONS)
    rows = signed(docs).withColumn("same", F.when(empty, F.lit(b"")).otherwise(F.col("same")))
    rows = written(rows, "signatures")
    classes = written(rows.groupBy("same").agg(F.min(F.struct("doc_id", "signature", "fp")).alias("r")).select("same", F.col("r.doc_id").alias("rep"), "r.signature", "r.fp"), "classes")
    worded = classes.filter(F.col("same") != F.lit(b""))
    near = components(_alike(worded.select("rep", "fp"), group_rows).unionAll(_candidates(worded.select("rep", "signature"), bands, group_rows)))
    near = near.unionAll(near.select(F.col("component").alias("node"), "component")).distinct()  # a star's centre has no row of its own
    bounded_batches(spark)
    texts = docs.join(near.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id").dropDuplicates(["doc_id", "text"])
    texts = written(texts.select("cluster", "doc_id", "text"), "texts")
    chunks = texts.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("text")) / (cluster_bytes / 2)).cast("int").alias("chunks"))
    # every pair of chunks of a large cluster meets in one cell; a small one is one cell
    chunks = chunks.withColumn("chunks", F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks")))
    dealt = texts.join(chunks, "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
    dealt = dealt.select("cluster", cell.alias("cell"), "doc_id", "text").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell")

    def of(batches):
        group, ids, sets = None, [], []

        def found():
            i, j = linked(sets, threshold)
            ids_ = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids_[i], pa.int64()), pa.array(ids_[j], pa.int64())], ["u", "v"])

        for b in batches:
            for c, cell, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if (c, cell) != group:
                    if len(ids) > 1:
                        yield found()
                    group, ids, sets = (c, cell), [], []
                ids.append(d)
                sets.append(np.unique(shingle_hashes([(text.as_py() or "").encode("utf-8", "surrogatepass")], wide=True)[0]))
        if len(ids) > 1:
            yield found()

    joined = components(dealt.mapInArrow(of, "u long, v long"))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("same").alias("class"), F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, F.col("same") == F.col("class")).select("doc_id", "component_id")
