import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ruleset

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    """Character by character, in Python's own terms."""
    text = text or ""
    words, lines = [w for w in _split(text) if w], text.split("\n")
    n, dense = max(1, len(words)), sum(map(len, words))
    count = lambda chars: sum(c in chars for c in text)
    old = sum(x in lines[:i] for i, x in enumerate(lines))
    return (
        len(words), dense / n, count("#$%&*+/<=>@[\\]^_`{|}~") / n, count("!?") / n, count(".,;:") / n, count("0123456789") / max(1, len(text)),
        sum("A" <= c <= "Z" for c in text) / max(1, dense), sum(a == b for a, b in zip(words, words[1:])) / n, len(words) / len(lines), old / len(lines),
    )


def _split(text):
    out = [""]
    for c in text:
        if c in " \t\n\v\f\r":
            out.append("")
        else:
            out[-1] += c
    return out


def test_statistics_against_plain_counts():
    r = random.Random(1)
    texts = [None, "", " \n", "été été x 日本 😀 A", "a a a b\nb\n\nb !? #1.,"] + ["".join(r.choice("ab A1.#!\n\té😀 ") for _ in range(r.randrange(60))) for _ in range(300)]
    for t in texts:
        assert ruleset.statistics((t or "").encode()) == pytest.approx(plain_statistics(t), abs=1e-12), t


def test_rules_find_a_conjunction():
    """Label 0 where two statistics meet, which no single comparison tells."""
    r = np.random.default_rng(5)
    x = r.random((1500, len(ruleset.STATISTICS)))
    y = 1.0 - ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4))
    m = ruleset.learnt(x, y)
    test = r.random((3000, len(ruleset.STATISTICS)))
    want = 1.0 - ((test[:, 0] > 0.5) & (test[:, 3] <= 0.4))
    assert np.mean((m.of(test) >= 0) == want) > 0.97
    assert any({c[0] for c in conditions} == {"words", "cries"} for conditions, _ in m.rules)
    assert ruleset.learnt(x, y) == m


def test_lasso_is_at_its_minimum():
    """No weight can move without the penalised loss going up (conditions of the optimum)."""
    r = np.random.default_rng(2)
    z = (r.random((600, 12)) < 0.3).astype(float)
    y = (r.random(600) < 1 / (1 + np.exp(1 - 2 * z[:, 0] + 1.5 * z[:, 1]))).astype(float)
    w, bias = ruleset.lasso(z, y, 0.02)
    spread = z.std(axis=0)
    slope = (z.T @ (1 / (1 + np.exp(-(z @ w + bias))) - y)) / 600 / spread
    assert np.all(np.abs(slope[w == 0]) <= 0.02 + 1e-3) and (w == 0).sum() >= 5
    assert np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3) and w[0] > 0 > w[1]


def test_compiled_column_is_the_ensemble(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = ruleset.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert m.rules
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in ruleset.scored(docs, m).collect()}
    for r in docs.collect():
        odds = m.of(np.array([ruleset.statistics((r["text"] or "").encode())]))[0]
        score, predicted = got[r["doc_id"]]
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9) and predicted == int(score >= 0.5)


def test_held_out_accuracy(spark):
    rows = ruleset.op13_rules(spark, SF).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(ruleset.fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert ruleset.fitted(docs, turned) == ruleset.fitted(docs, labels)


def test_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = ruleset.fitted(odd_docs, none)
    assert m.rules == () and ruleset.fitted(no_docs, none) == m
    some = ruleset.Ensemble((((("words", False, 20.0), ("marks", True, 0.5)), -2.0),), 0.5)
    odd = odd_docs.withColumn("statistics", F.lit("x")).withColumn("score", F.lit(1))
    got = ruleset.scored(odd, some, keep=odd.columns, out=("s", "p"))
    assert got.count() == odd.count() and got.columns == [*odd.columns, "s", "p"]
    assert got.filter("s is null or s < 0 or s > 1").count() == 0
    assert ruleset.scored(no_docs, m).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (7, 1, 0), (7, 0, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    x, y = ruleset.training_rows(odd_docs, labels)
    assert len(x) == len(y) <= 3
    assert len(ruleset.training_rows(odd_docs, labels, (1, 0))[1]) <= 1
