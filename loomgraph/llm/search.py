"""Ranked lexical search on dual-sorted postings.

The documents of a shard are numbered by length. Its postings, one list a term and each by falling impact, are
one sequence of document numbers, kept as a wavelet tree: a bit of every number by level, stably sorted by the
bits before it. So a list is a range at the root in order of impact, and below a node, which stands for an
interval of numbers, still a range in that order: its first posting bounds what the term can add to any
document of the interval. A search goes down from the root, best bound first, in the ranges of all terms of the
query at once; a leaf is a document and its bound the score. What is bounded under the k best so far is never
opened, so the k best are exact."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, shared_dir, table

#: Bytes of text after which a shard is closed: a document is in one shard, whatever its length.
SHARD_BYTES = 16 << 20
#: Items that are searched together, and bytes of their texts, beyond one item.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 8 << 20
#: Nodes of the trees that are opened together.
STEP = 512
TOP = 10

#: Bytes that no term has become blanks, A to Z small letters.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters and digits and of all beyond ASCII."""
    return (text or b"").translate(_PLAIN).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of the documents with a term, and of all their terms."""

    def of(batches):
        n = total = 0
        for b in batches:
            for x in b.column(0):
                size = len(terms(x.as_py()))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    bounded_batches(docs.sparkSession)
    got = docs.select(F.col(text).cast("binary")).mapInArrow(of, "n long, total long")
    return tuple(got.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


class Vocabulary(dict):
    """term -> its number in the shard."""

    def __missing__(self, term: bytes) -> int:
        self[term] = k = len(self)
        return k


def shard_of(ids: list, texts: list[list[bytes]], n: int, total: int) -> dict:
    """A shard of documents that have terms: ids by number, its terms with the lengths of their lists, the impacts
    and the tree's bits by level.

    A posting's impact is (10^9 tf) div (1000 tf + 8 m), of a document's m = 10 + (90 n N) div L."""
    order = sorted(range(len(ids)), key=lambda k: len(texts[k]))
    vocabulary, docs = Vocabulary(), len(ids)
    sizes = [len(texts[k]) for k in order]
    term = np.fromiter((vocabulary[t] for k in order for t in texts[k]), np.int64, sum(sizes))
    place, tf = np.unique(term * docs + np.repeat(np.arange(docs), sizes), return_counts=True)
    term, doc = np.divmod(place, docs)
    m = np.array([10 + 90 * s * n // total for s in sizes], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])  # at most 10^6
    by_impact = np.argsort(term * (1 << 20) - impact, kind="stable")
    doc, impact = doc[by_impact].astype(np.int32), impact[by_impact].astype(np.int32)
    lists = np.bincount(term, minlength=len(vocabulary))
    bits, levels = [], (docs - 1).bit_length()
    for level in range(levels):
        one = (doc >> (levels - 1 - level)) & 1 > 0
        bits.append(np.packbits(one).tobytes())
        doc = np.concatenate([doc[~one], doc[one]])
    return {"ids": [ids[k] for k in order], "terms": list(vocabulary), "lists": lists, "impacts": impact.tobytes(), "bits": b"".join(bits)}


_SHARD = "docs int, ids array<{kind}>, terms array<binary>, lists array<int>, impacts binary, bits binary"


def index(docs: DataFrame, n: int, total: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of all documents with a term, written: a row each. Shards are runs of a task's rows, so no text is moved.

    n, total: see statistics(). A null key is an id like any other; rows that share one are documents of their own."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(spark)

    def of(batches):
        def row(ids, texts):
            s = shard_of(ids.to_pylist() if isinstance(ids, pa.Array) else ids, texts, n, total)
            kinds = [pa.int32(), pa.list_(id_type), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            values = [len(ids), s["ids"], s["terms"], s["lists"], s["impacts"], s["bits"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["docs", "ids", "terms", "lists", "impacts", "bits"])

        ids, texts, size, id_type = [], [], 0, pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = x.as_py()
                if found := terms(x):
                    ids.append(k)
                    texts.append(found)
                    size += len(x)
                    if size >= shard_bytes:
                        yield row(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    path = f"{shared_dir(spark)}/shards"
    shards = docs.select(key, F.col(text).cast("binary").alias("text")).mapInArrow(of, _SHARD.format(kind=kind))
    # rows of many megabytes: row groups are closed by bytes, not by hundreds of rows
    shards.write.option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


class Shard:
    """A shard for searching: ones before each place, and impacts, by level."""

    def __init__(self, ids: list, names: list[bytes], lists: np.ndarray, impacts: bytes, bits: bytes):
        self.ids, self.levels = ids, (len(ids) - 1).bit_length()
        self.starts = np.concatenate([[0], np.cumsum(lists, dtype=np.int64)])
        self.at = {t: k for k, t in enumerate(names)}
        impact = np.frombuffer(impacts, np.int32)
        n = self.n = len(impact)
        row = (n + 7) // 8
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int32)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = impact
        for level in range(self.levels):
            one = np.unpackbits(np.frombuffer(bits, np.uint8, row, level * row), count=n).astype(bool)
            np.cumsum(one, out=self.ones[level, 1:])
            self.zeros[level] = zeros = n - int(self.ones[level, n])
            before = self.impacts[level, :n]
            np.compress(~one, before, out=self.impacts[level + 1, :zeros])
            np.compress(one, before, out=self.impacts[level + 1, zeros:n])

    def search(self, query: Query, best: Best) -> None:
        """Adds to the best what this shard has of the query: terms, each once, with their weights."""
        found = [(self.at[t], w) for t, w in query if w > 0 and t in self.at]
        if not found:
            return
        lists, w = np.array([k for k, _ in found]), np.array([w for _, w in found], np.int64)
        start, end = self.starts[lists][None].astype(np.int32), self.starts[lists + 1][None].astype(np.int32)
        level, low = np.zeros(1, np.int32), np.zeros(1, np.int64)
        bound = (self.impacts[0][start] * w).sum(axis=1)
        if self.levels == 0:
            best.add(bound, self.ids, np.zeros(1, np.int64))
            return
        ones, impacts, width = self.ones.ravel(), self.impacts.ravel(), self.n + 1
        nodes = (level, low, bound, start, end)
        while True:
            open_ = nodes[2] >= best.least()
            nodes = tuple(v[open_] for v in nodes)
            if not len(nodes[0]):
                return
            if len(nodes[0]) > STEP:
                far = np.argpartition(-nodes[2], STEP)
                (level, low, _, start, end), nodes = (v[far[:STEP]] for v in nodes), tuple(v[far[STEP:]] for v in nodes)
            else:
                (level, low, _, start, end), nodes = nodes, tuple(v[:0] for v in nodes)
            base = (level * np.int64(width))[:, None]
            s1, e1 = ones[base + start], ones[base + end]
            zeros = self.zeros[level][:, None]
            start, end = np.concatenate([start - s1, zeros + s1]), np.concatenate([end - e1, zeros + e1])
            level, low = np.concatenate([level, level]) + 1, np.concatenate([2 * low, 2 * low + 1])
            first = impacts[np.concatenate([base, base]) + width + start]
            bound = np.where(end > start, first, 0).astype(np.int64) @ w
            alive = bound >= best.least()
            leaf = alive & (level == self.levels)
            if leaf.any():
                best.add(bound[leaf], self.ids, low[leaf])
            inner = alive & (level < self.levels)
            nodes = tuple(np.concatenate([a, b[inner]]) for a, b in zip(nodes, (level, low, bound, start, end)))


class Best:
    """The k highest scores so far, of equal ones the smallest ids, null last."""

    def __init__(self, k: int = TOP):
        self.k, self.found = k, []

    def least(self) -> int:
        """A lower score than this can't be among them."""
        return self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, ids: list, numbers: np.ndarray) -> None:
        got = self.found + [(s, ids[d]) for s, d in zip(scores.tolist(), numbers.tolist()) if s > 0]
        self.found = sorted(got, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[: self.k]


#: A query: its terms, each once, with their weights.
Query = list[tuple[bytes, int]]


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of a bounded size, each with its distinct terms: as a stream, a block at a time on the driver."""
    block, size = [], 0
    for r in items.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).toLocalIterator():
        found = list(dict.fromkeys(terms(r["text"])))
        if block and (len(block) == BLOCK_ITEMS or size + len(r["text"] or b"") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        if found:
            block.append((r["key"], found))
            size += len(r["text"])
    if block:
        yield block


def frequencies(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Number of the documents that hold each wanted term, over all shards; only the shards' dictionaries are read."""
    spark = shards.sparkSession
    some = spark.createDataFrame([(bytearray(t),) for t in sorted(wanted)], "term binary")  # a block's terms
    entry = F.explode(F.arrays_zip("terms", "lists")).alias("entry")
    held = shards.select(entry).select(F.col("entry.terms").alias("term"), F.col("entry.lists").alias("n"))
    got = held.join(F.broadcast(some), "term").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in got.collect()}


def found(shards: DataFrame, queries: list[Query], k: int) -> DataFrame:
    """number (of the query), doc and score of the k best of each task's shards: what one shard found bounds the next."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)  # a block of items
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def of(batches):
        best, id_type = [Best(k) for _ in shared.value], None
        for b in batches:
            id_type = b.schema.field("ids").type.value_type
            for r in range(b.num_rows):
                ids, names, lists, impacts, bits = (b.column(c)[r] for c in ("ids", "terms", "lists", "impacts", "bits"))
                shard = Shard(ids.as_py(), names.as_py(), lists.values.to_numpy(), impacts.as_buffer(), bits.as_buffer())
                for query, known in zip(shared.value, best):
                    shard.search(query, known)
        if id_type is not None:
            got = [(i, d, s) for i, known in enumerate(best) for s, d in known.found]
            number, doc, score = zip(*got) if got else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["number", "doc", "score"])

    return shards.select("ids", "terms", "lists", "impacts", "bits").mapInArrow(of, f"number int, doc {kind}, score long")


def ranked(shards: DataFrame, items: DataFrame, n: int, k: int = TOP, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item key, rank (from 1), document key and score of the k best documents of each item with a score above 0: a sum over
    the item's distinct terms of weight times impact. n: the documents with a term.

    Equal scores by ascending key, null last; items without terms, null or empty, have no rows; an item that is there
    twice is ranked twice; no shards or no items give no rows. Each block of items is one pass over the shards."""
    spark = shards.sparkSession
    base, paths = f"{shared_dir(spark)}/found", []
    item_kind, doc_kind = items.schema[item_key].dataType.simpleString(), shards.schema["ids"].dataType.elementType.simpleString()
    for block in blocks(items, item_key, text):
        df = frequencies(shards, {t for _, ts in block for t in ts})
        got = found(shards, [[(t, weight(n, df[t])) for t in ts if t in df] for _, ts in block], k)
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        keys = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"number int, item {item_kind}")  # a block's
        got = got.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(keys), "number")
        paths.append(f"{base}/block={len(paths)}")
        got.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score").write.parquet(paths[-1])
    schema = f"`{item_key}` {item_kind}, rank int, `{key}` {doc_kind}, score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents")
    n, total = statistics(docs)
    return ranked(index(docs, n, total), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, rowid AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
 FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
p AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, sum(tf)::HUGEINT AS n FROM p GROUP BY r),
a AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM d),
m AS (SELECT r, (100 - 90 + (90 * n * docs) // total)::BIGINT AS m FROM d, a),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, p.r, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
 FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY item_id, p.r, p.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
