"""A quality classifier as a sparse ensemble of rules.

Small boosted trees are grown on statistics of a bounded sample of labelled documents. Every path from a
root to a node is a rule: a conjunction of comparisons of statistics with thresholds. A logistic model with a
lasso penalty gives the rules their weights, most of them zero, and the rest is compiled into one Spark column:
the sum of the weights of the rules that hold, as log odds. The statistics are counts of bytes, words and lines, one
pass over a text in Arrow batches: as column expressions they took more than twice the time (a regular expression each)."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table, unused

#: Labelled documents that the rules are learnt from, at most, of either label.
SAMPLE = (2000, 2000)
TREES, DEPTH, BINS, LEAST, SHRINK = 40, 3, 24, 5, 0.3
#: Penalties that are tried, the strongest first; the share of the sample that chooses among them.
PENALTIES, CHOOSING, STEPS = (0.03, 0.01, 0.003, 0.001), 4, 400
FOLDS = 3

STATISTICS = ("words", "word_length", "marks", "cries", "ends", "digits", "capitals", "repeated", "line_words", "old_lines")

_MARKS, _ENDS, _CRIES, _DIGITS = b"#$%&*+/<=>@[\\]^_`{|}~", b".,;:", b"!?", b"0123456789"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def statistics(text: bytes) -> tuple[float, ...]:
    """What rules may ask of a text in UTF-8: its words, and shares of words, characters or lines, 0 where there are none.

    Words are what stands between ASCII blanks; repeated ones equal the word before them, old lines an earlier line."""
    words, lines = text.split(), text.split(b"\n")
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = lambda chars: float(seen[list(chars)].sum())
    chars, n = float(seen.sum() - seen[0x80:0xC0].sum()), max(1, len(words))  # without bytes inside of a character
    dense = chars - of(b" \t\n\v\f\r")
    return (
        float(len(words)),
        dense / n,
        of(_MARKS) / n,
        of(_CRIES) / n,
        of(_ENDS) / n,
        of(_DIGITS) / max(1.0, chars),
        of(_CAPITALS) / max(1.0, dense),
        sum(map(eq, words, words[1:])) / n,
        len(words) / len(lines),
        (len(lines) - len(set(lines))) / len(lines),
    )


#: A condition: statistic, whether it has to be greater, threshold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Ensemble:
    """Rules, each a conjunction, with their weights; bias: the log odds where no rule holds."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    bias: float

    def log_odds(self, stats: dict[str, Column]) -> Column:
        """The rules as one column over columns of the statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, greater, threshold in conditions:
                holds &= (stats[name] > threshold) if greater else (stats[name] <= threshold)
            total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def of(self, x: np.ndarray) -> np.ndarray:
        """The log odds of rows of statistics."""
        out = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            out += weight * holds(conditions, x)
        return out


def holds(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, greater, threshold in conditions:
        v = x[:, STATISTICS.index(name)]
        out &= (v > threshold) if greater else (v <= threshold)
    return out


def thresholds(x: np.ndarray) -> list[np.ndarray]:
    """Of each statistic: values half way between neighbours, at quantiles of those that differ."""
    out = []
    for v in x.T:
        u = np.unique(v)
        mid = (u[1:] + u[:-1]) / 2
        out.append(mid if len(mid) <= BINS else np.unique(np.quantile(mid, np.linspace(0, 1, BINS), method="nearest")))
    return out


def paths(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """A regression tree on the target: the conditions that lead to each of its nodes, and its value in each row."""
    found, value = [], np.zeros(len(x))

    def grow(rows: np.ndarray, conditions: tuple[Condition, ...]) -> None:
        if conditions:
            found.append(conditions)
        value[rows] = target[rows].mean()
        if len(conditions) == DEPTH or len(rows) < 2 * LEAST:
            return
        y, best = target[rows], (1e-9, None, None)
        for k, at in enumerate(cuts):
            if not len(at):
                continue
            place = np.searchsorted(at, x[rows, k], side="left")  # of a value up to at[i], but over at[i - 1]: i
            n = np.bincount(place, minlength=len(at) + 1).cumsum()[:-1]
            s = np.bincount(place, y, minlength=len(at) + 1).cumsum()[:-1]
            ok = (n >= LEAST) & (len(rows) - n >= LEAST)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - y.sum() ** 2 / len(rows), 0)
            if gain.max() > best[0]:
                best = (gain.max(), k, float(at[gain.argmax()]))
        if best[1] is None:
            return
        _, k, cut = best
        left = x[rows, k] <= cut
        for side, greater in ((rows[left], False), (rows[~left], True)):
            grow(side, (*conditions, (STATISTICS[k], greater, cut)))

    grow(np.arange(len(x)), ())
    return found, value


def grown(x: np.ndarray, y: np.ndarray, seed: int) -> list[tuple[Condition, ...]]:
    """The paths of boosted trees, each on a random half of the rows; of rules that hold in the same rows the
    shortest stays."""
    r, cuts, odds, found = np.random.default_rng(seed), thresholds(x), np.zeros(len(y)), []
    for _ in range(TREES):
        rest = y - 1 / (1 + np.exp(-odds))
        part = np.sort(r.permutation(len(y))[: max(2 * LEAST, len(y) // 2)])
        nodes, _ = paths(x[part], rest[part], cuts)
        found += nodes
        leaves = [c for c in nodes if not any(len(d) > len(c) and d[: len(c)] == c for d in nodes)]
        for c in leaves:
            at = holds(c, x)
            p = 1 / (1 + np.exp(-odds[at]))
            if at.any():
                odds[at] += SHRINK * np.clip(rest[at].sum() / max(1e-3, (p * (1 - p)).sum()), -4, 4)
    kept: dict[bytes, tuple[Condition, ...]] = {}
    for c in sorted(found, key=len):
        at = holds(c, x)
        if LEAST <= at.sum() <= len(at) - LEAST:
            same = min(np.packbits(at).tobytes(), np.packbits(~at).tobytes())
            kept.setdefault(same, c)
    return list(kept.values())


def lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression with a penalty on the weights' absolute values, by accelerated
    proximal gradient; the bias is free. Columns are scaled to spread 1, so rare rules aren't shut out."""
    spread = np.maximum(z.std(axis=0), 1e-9)
    a, mean = z / spread, (z / spread).mean(axis=0)
    a = a - mean
    pace = 4 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w, bias, momentum = np.zeros(a.shape[1]), np.log(rate / (1 - rate)), 1.0
    u, ubias = w, bias
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ u + ubias, -60, 60)))
        step = u - pace * (a.T @ (p - y)) / len(y)
        new, new_bias = np.sign(step) * np.maximum(np.abs(step) - pace * penalty, 0), ubias - pace * (p - y).mean()
        t = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        u, ubias = new + (momentum - 1) / t * (new - w), new_bias + (momentum - 1) / t * (new_bias - bias)
        w, bias, momentum = new, new_bias, t
    return w / spread, float(bias - w @ mean)


def learnt(x: np.ndarray, y: np.ndarray, seed: int = 13) -> Ensemble:
    """Rules and weights from rows of statistics and their labels; the same rows give the same rules.

    The strongest penalty whose loss on a quarter of the rows is within a tenth of the best is taken. Without
    rows of both labels no rule is learnt: the bias says the share of label 1."""
    y = np.asarray(y, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 4 * LEAST or min(y.sum(), len(y) - y.sum()) < 1:
        return Ensemble((), float(np.log(rate / (1 - rate))))
    rules = grown(x, y, seed)
    if not rules:
        return Ensemble((), float(np.log(rate / (1 - rate))))
    z = np.stack([holds(c, x) for c in rules], axis=1).astype(float)
    test = np.random.default_rng(seed).permutation(len(y)) % CHOOSING == 0
    loss = []
    for penalty in PENALTIES:
        w, bias = lasso(z[~test], y[~test], penalty)
        odds = np.clip(z[test] @ w + bias, -60, 60)
        loss.append(float(np.mean(np.logaddexp(0, odds) - y[test] * odds)))
    penalty = next(p for p, v in zip(PENALTIES, loss) if v <= 1.1 * min(loss) + 1e-3)
    w, bias = lasso(z, y, penalty)
    return Ensemble(tuple((c, float(v)) for c, v in zip(rules, w) if abs(v) > 1e-6), bias)


def fold(doc_id: str) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def with_statistics(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The kept columns and the statistics of each row, in one column of a free name; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    kept = docs.select([F.col(f"`{c}`") for c in keep])
    name, n = unused(kept, "statistics"), len(keep)
    fields = ", ".join(f"{k}: double" for k in STATISTICS)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + f"`{name}` struct<{fields}>"

    def of(batches):
        for b in batches:
            rows = [statistics(x.as_py() or b"") for x in b.column(n)]
            cols = [pa.array(c, pa.float64()) for c in zip(*rows)] or [pa.array([], pa.float64())] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.StructArray.from_arrays(cols, STATISTICS)], [*keep, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias(name)).mapInArrow(of, schema)
    return rows, {k: F.col(f"`{name}`.`{k}`") for k in STATISTICS}


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of at most `sample` documents of label 1 and 0, by a hash of doc_id, of the rows whose fold
    isn't 1. Only numbers come to the driver, a bounded count of them.

    Rows without a label or an id are left out; of rows that share an id one counts, the same each time."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(fold("doc_id") != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64(F.lit(13), "doc_id"), F.col("doc_id")
    ids = known.filter("quality = 1").orderBy(*order).limit(sample[0]).unionAll(known.filter("quality = 0").orderBy(*order).limit(sample[1]))
    rows, stats = with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), ["doc_id", "quality"])
    rows = rows.select("doc_id", "quality", F.array(*[stats[k] for k in STATISTICS]).alias("x")).groupBy("doc_id", "quality").agg(F.max("x").alias("x"))
    got = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.collect())
    return np.array([r[2] for r in got], float).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], float)


def fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Ensemble:
    return learnt(*training_rows(docs, labels, sample))


def scored(docs: DataFrame, model: Ensemble, keep: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id (or the columns `keep`), score (0 to 1) and predicted of every row, from the whole text alone. `out` names the
    two, where kept columns have their names.

    A null text counts as empty, and an empty one's statistics are all 0; a null doc_id and repeated rows come out as
    they are; no rows give no rows."""
    keep = keep or ["doc_id"]
    rows, stats = with_statistics(docs, keep)
    odds = model.log_odds(stats)
    score = 1 / (1 + F.exp(-odds))
    return rows.select(*[F.col(f"`{c}`") for c in keep], score.alias(out[0]), (odds >= 0).cast("int").alias(out[1]))


def op13_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")
