"""Toxicity scores from a bag of subword embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams and of itself, a text the mean of its words;
a linear softmax reads the text's vector. Embeddings and softmax are trained together, by Adam in numpy, on
a bounded sample of labelled documents. A misspelling that training never saw still shares n-grams with the
word it disguises. Subwords get an embedding if the sample's labels say anything about them (a z-score of
their share of label 1); all others are zero vectors. As all is linear, a subword's part in the log odds is
one number, so scoring needs no matrices."""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import WORD, bounded_batches, table

#: Labelled documents used for training, at most: of label 1, of label 0; and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = (1500, 2500), 48 << 20
BUCKETS, DIM, EPOCHS, STEPS, BATCH, RATE, GAIN, DECAY = 1 << 18, 4, 40, 300, 128, 0.1, 100.0, 3e-5
#: Words of no meaning that each text is taken to have besides its own: a few words alone prove little.
BLANKS = 10
#: A subword counts if it is in so many sampled documents, at such a distance from the share of label 1.
LEAST_DOCS, LEAST_Z = 4, 4.5
FOLDS = 5
#: Bytes of a word, with its marks, that are read as one; words of up to SHORT characters hardly have more.
PIECE, SHORT = 64, 10

_WORDS = re.compile(WORD)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """Lower case, composed, without marks around it."""
    w = word.lower()
    if not w.isascii():
        w = unicodedata.normalize("NFC", w)
    return w if w.isalnum() else _EDGE.sub("", w) or w


def pieces(word: str) -> list[bytes]:
    """A normal word with its ends marked; a longer one than PIECE bytes as consecutive pieces that overlap by five bytes, so
    that each n-gram is in one. Each counts as a word: an unspaced sentence weighs by its length."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    return [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - 5, PIECE - 5)]


def subwords(w: bytes) -> list[bytes]:
    """A piece and its n-grams of 4 to 6 bytes."""
    n = len(w)
    return [w, *[w[i : i + 4] for i in range(n - 3)], *[w[i : i + 5] for i in range(n - 4)], *[w[i : i + 6] for i in range(n - 5)]]


@dataclass
class Model:
    """share: subword -> what it adds to the log odds of label 1 in a word of its own; bias: the rest."""

    share: dict
    bias: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def of_word(self, word: str) -> float:
        """The sum of its pieces' shares."""
        total = 0.0
        for w in pieces(word):
            parts = subwords(w)
            got = [self.share[p] for p in parts if p in self.share]
            total += sum(got) / len(parts) if got else 0.0
        return total


class WordScores(dict):
    """word -> its share, for one model; emptied when it holds too many words; long words are not held."""

    LIMIT = 500_000

    def __init__(self, model: Model):
        self.model, self.plain = model, {}

    def __missing__(self, word: str) -> float:
        if len(self) > self.LIMIT:
            self.clear()
            self.plain.clear()
        w = normal(word)
        if len(word) > PIECE:
            return self.model.of_word(w)
        got = self.plain.get(w)
        if got is None:
            got = self.plain[w] = self.model.of_word(w)
        self[word] = got
        return got

    def log_odds(self, text: str | None) -> float:
        words = _WORDS.findall(text or "")
        n = len(words) + sum(len(pieces(normal(w))) - 1 for w in words if len(w) > SHORT)
        return self.model.bias + (sum(map(self.__getitem__, words)) / (n + BLANKS) if words else 0.0)


_kept: dict[str, WordScores] = {}


def word_scores(model: Model) -> WordScores:
    """The cache of this worker for a model; only the last model's is kept."""
    if model.key not in _kept:
        _kept.clear()
        _kept[model.key] = WordScores(model)
    return _kept[model.key]


class Bags:
    """Texts as counts of their words' pieces, and the pieces' buckets side by side: a few numbers a word, however
    often it is said."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {}
        flat, ends, self.texts = array("i"), array("q", [0]), []
        for text in texts:
            seen: dict[int, int] = {}
            n = 0
            for word in _WORDS.findall(text or ""):
                for w in pieces(normal(word)):
                    k = known.get(w)
                    if k is None:
                        k = known[w] = len(known)
                        flat.extend(zlib.crc32(p) & (BUCKETS - 1) for p in subwords(w))
                        ends.append(len(flat))
                    seen[k] = seen.get(k, 0) + 1
                    n += 1
            self.texts.append((np.fromiter(seen, np.int32, len(seen)), np.fromiter(seen.values(), np.int32, len(seen)), n))
        self.words, self.flat = list(known), np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        self.ends = np.frombuffer(ends, np.int64)

    def buckets(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's pieces in turn: their subwords' buckets, and the weight of each; the weights sum to nearly one."""
        at, count, n = self.texts[i]
        size = self.ends[at + 1] - self.ends[at]
        place = np.repeat(self.ends[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.flat[place], np.repeat(count / np.maximum(size, 1) / (n + BLANKS), size)

    def of(self, i: int, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's kept buckets by their new numbers (to: -1 for others), each once, with its weight."""
        bucket, weight = self.buckets(i)
        kept = to[bucket] >= 0
        new, back = np.unique(to[bucket[kept]], return_inverse=True)
        return new.astype(np.int32), np.bincount(back, weights=weight[kept], minlength=len(new)).astype(np.float32)


def trained(texts: list[str | None], labels: list[int], seed: int = 3) -> Model:
    """Embeddings and softmax by Adam on the cross-entropy; the same rows give the same shares.

    Without rows of both labels the model knows the share of label 1 only."""
    y = np.array(labels, np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, float(np.log(rate / (1 - rate))))
    said = Bags(texts)
    docs, ones = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i, t in enumerate(y):  # a text has each bucket once
        b = np.unique(said.buckets(i)[0])
        docs[b] += 1
        ones[b] += t
    z = (ones - docs * rate) / np.sqrt(np.maximum(docs, 1) * rate * (1 - rate))
    keep = (docs >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
    to = np.full(BUCKETS, -1)
    to[keep] = np.arange(keep.sum())
    bags = [said.of(i, to) for i in range(len(y))]
    size = np.array([len(b) for b, _ in bags])
    r, n = np.random.default_rng(seed), int(keep.sum())
    x = {"e": np.zeros((n, DIM)), "w": r.normal(0, 1, (DIM, 2)) / np.sqrt(DIM), "bias": np.log(np.array([1 - rate, rate]))}
    first, second = ({k: np.zeros_like(v) for k, v in x.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, int(np.ceil(STEPS * BATCH / len(y))))
    total = epochs * (len(y) // BATCH + 1)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick, step = order[lo : lo + BATCH], step + 1
            bucket = np.concatenate([bags[i][0] for i in pick])
            weight = np.concatenate([bags[i][1] for i in pick]) * GAIN
            row = np.repeat(np.arange(len(pick)), size[pick])
            mean = np.stack([np.bincount(row, weight * x["e"][bucket, k], len(pick)) for k in range(DIM)], axis=1)
            out = mean @ x["w"] + x["bias"]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = p @ x["w"].T
            slope = {"e": np.stack([np.bincount(bucket, weight * back[row, k], n) for k in range(DIM)], axis=1) + DECAY * x["e"], "w": mean.T @ p, "bias": p.sum(axis=0)}
            pace = RATE * max(0.05, 1 - step / total)
            for k, g in slope.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                x[k] -= pace * (1 if k == "e" else 0.2) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    share = GAIN * x["e"] @ (x["w"][:, 1] - x["w"][:, 0])
    shares = {}
    some = np.flatnonzero(np.add.reduceat(keep[said.flat].astype(np.int32), said.ends[:-1])) if len(said.flat) else []
    for k in some:  # subwords of the sample only: another one that falls into their bucket says nothing
        for p, b in zip(subwords(said.words[k]), said.flat[said.ends[k] : said.ends[k + 1]]):
            if keep[b]:
                shares[p] = float(share[to[b]])
    return Model(shares, float(x["bias"][1] - x["bias"][0]))


def fold(doc_id: str) -> F.Column:
    """crc32 of the doc_id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list:
    """(doc_id, text, toxic) of at most `sample` documents of label 1 and 0 outside fold 0, by a hash of doc_id, as many as
    have sample_bytes together: half for each label, and no text has more than a quarter.

    Only the ids of the sample are broadcast; rows without a label or an id are left out, of rows that share an id the
    greatest text counts."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")
    ids = known.filter("toxic = 1").orderBy(*order).limit(sample[0]).unionAll(known.filter("toxic = 0").orderBy(*order).limit(sample[1]))
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // 4
    rows = docs.select("doc_id", "text").filter(fits).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    # a row a document of the sample: the sums run over a bounded table, half of the bytes for each label
    upto = Window.partitionBy("toxic").orderBy(*order)
    rows = rows.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)).filter(F.col("bytes") <= sample_bytes // 2)
    return sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.toLocalIterator())


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    rows = training_sample(docs, labels, sample)
    return trained([t for _, t, _ in rows], [y for _, _, y in rows])


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id (or the columns `keep`), score (0 to 1) and predicted of every row, from the whole text alone.
    `out` names the two, where kept columns have their names.

    A null or empty text has the model's bias as its log odds; a null doc_id and repeated rows come out as
    they are; no rows give no rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, whatever the input
    keep = keep or ["doc_id"]
    fields = docs.select(keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out[0]}` double, `{out[1]}` int"
    n = len(keep)
    at = keep.index("text") if "text" in keep else n

    def of(batches):
        words = word_scores(shared.value)
        for b in batches:
            odds = np.array([words.log_odds(t.as_py()) for t in b.column(at)], np.float64)
            p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, *out])

    extra = [] if at < n else [F.col("text").alias("text to score")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *extra).mapInArrow(of, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
