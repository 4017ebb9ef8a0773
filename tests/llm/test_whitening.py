import random
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from loomgraph.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """x, S, n and n^3 V in Python's integers, one number at a time."""
    width = max(map(len, vectors), default=0)
    x = [[floor(1024 * Fraction(float(c))) + 100000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    gram = [[sum(row[i] * row[j] for row in y) for j in range(width)] for i in range(width)]
    return x, sums, n, y, gram


def held(rows, vectors, components=8):
    """Rows of the query against the definition. vectors: by key, usable ones."""
    keys = list(vectors)
    x, sums, n, y, gram = plain([vectors[k] for k in keys])
    v = np.array([[Fraction(g, n**3) for g in row] for row in gram], float)
    values = np.linalg.eigvalsh(v)[::-1]
    count = min(components, len(v))
    assert len(rows) == len(keys) * count
    got = {(r["vec_id"], r["component"]): r for r in rows}
    white = np.array([[got[k, c + 1]["whitened"] for c in range(count)] for k in keys], float)
    for k, row in zip(keys, y):
        assert all(got[k, c + 1]["deviation"] == sum(a * a for a in row) and got[k, c + 1]["n"] == n for c in range(count))
    z = np.array(y, float) / n
    for c in range(count):
        assert got[keys[0], c + 1]["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
        back = np.linalg.lstsq(z, white[:, c] * np.sqrt(values[c]), rcond=None)[0]
        assert np.allclose(v @ back, values[c] * back, atol=1e-7 * values[0]) and np.linalg.norm(back) == pytest.approx(1, abs=1e-7)
    cov = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / n
    error = rows[0]["identity_error"]
    assert error == pytest.approx(np.abs(cov - np.eye(count)).max(), abs=1e-9) and error <= 1e-4
    assert len({r["identity_error"] for r in rows}) == 1


def test_query_against_python_integers(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    usable = {k: v for k, v in vectors.items() if v is not None and all(c is not None and isfinite(c) for c in v)}
    held(whitening.op11_whitening(spark, SF).collect(), usable)


def test_gram_is_exact_for_any_integers():
    r = random.Random(4)
    for bits in (3, 15, 16, 17, 31, 33, 50, 62, 90):
        y = [[r.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(200)] + [[-(1 << bits)] * 5, [1 << bits] * 5, [0] * 5]
        a = np.array(y, object if bits > 62 else np.int64)
        assert (sum(p.astype(object) * (1 << (whitening.LIMB * k)) for k, p in enumerate(map(np.vectorize(int, otypes=[object]), whitening.limbs(a)))) == a.astype(object)).all()
        g = whitening.Gram(5)
        g.add(a[:100])
        g.add(a[100:])
        found = {}
        for i, j, k, v in g.entries():
            found[i, j] = found.get((i, j), 0) + (v << (whitening.LIMB * k))
        assert found == {(i, j): sum(row[i] * row[j] for row in y) for i in range(5) for j in range(i, 5)}


def test_product_of_a_full_block_is_exact():
    """The largest limbs, as many as a block has: float64 has each of their sums."""
    y = np.full((whitening.BLOCK, 1), (1 << 16) - 1 + ((1 << 15) << 16), np.int64)
    g = whitening.Gram(1)
    g.add(y)
    assert sum(v << (whitening.LIMB * k) for _, _, k, v in g.entries()) == whitening.BLOCK * int(y[0, 0]) ** 2


def test_digits():
    for v in (0, 1, -1, 1 << 63, -(1 << 63), (1 << 200) + 7, -(1 << 200) - 7):
        assert sum(d << (whitening.DIGIT * k) for k, d in whitening.digits(v)) == v


def test_edges(spark):
    """Nulls, bad entries, short and empty vectors, repeated rows, a third of the rows alike, extra columns."""
    r = np.random.default_rng(7)
    rows = [(k, [float(c) for c in r.normal(0, 1, 4)], "x") for k in range(60)] + [(k, [0.5, -0.25, 1.0, 2.0], "y") for k in range(60, 90)]
    bad = [(100, None, "n"), (101, [1.0, None, 2.0, 3.0], "n"), (102, [float("nan"), 0.0, 0.0, 0.0], "n"), (103, [float("inf"), 0.0, 0.0, 0.0], "n"), (104, [0.0, -float("inf"), 0.0, 0.0], "n")]
    short = [(200, [1.0, 2.0], "s"), (201, [], "s"), (None, [1.0, 1.0, 0.0, 0.0], "s")]
    schema = "vec_id long, embedding array<float>, component string"
    df = spark.createDataFrame(rows + bad + short, schema).repartition(5)
    usable = {k: v for k, v, _ in rows + short}
    held(whitening.whitened(df).collect(), {k: np.array(v, np.float32).tolist() for k, v in usable.items()})
    twice = whitening.whitened(df.unionAll(df)).collect()
    assert len(twice) == 2 * 4 * len(usable) and {r["n"] for r in twice} == {2 * len(usable)}
    assert whitening.whitened(spark.createDataFrame(bad, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [], "e")], schema)).count() == 0


def test_no_variance(spark):
    """One row, or a dimension that follows from others: components without variance have no coordinate."""
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(1, None, 0.0, None, 0), (2, None, 0.0, None, 0)]
    flat = [(k, [float(k), 2.0 * k + 1, 3.0]) for k in range(20)]
    got = whitening.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and all(r["identity_error"] < 1e-4 for r in got)


def test_huge_entries(spark):
    """Integers beyond 64 bits; a deviation that no long holds is null."""
    rows = [(k, [1e30 * k, float(k % 3)]) for k in range(10)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 20 and all(r["deviation"] is None for r in got) and got[0]["identity_error"] < 1e-4
    n, sums = whitening.totals(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding")
    assert n == 10 and sums[0] == sum(floor(1024 * Fraction(v[0])) + 100000 for _, v in rows)
