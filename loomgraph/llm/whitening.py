"""Whitening of embeddings with exact covariances.

Vectors become integers x, the centred ones are y = n*x - S, integers again. Their Gram matrix is a digit-slice
product: y is cut into limbs of 16 bits, two limbs' product summed over a block of rows stays under 2^53, so
that float64 BLAS makes no error, and the products are added up by the sum of their limbs' places. The places
of all tasks merge as decimals in Spark, the driver shifts and adds them as big integers (one small matrix,
whatever the number of rows), divides once by n^3 and decomposes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_batches, table, written

#: A float64 has SCALE steps of an embedding's entry, from OFFSET on.
SCALE, OFFSET = 1024, 100_000
#: Bits of a limb, and rows of a block: a product of limbs summed over a block is at most 2^(32 + 20) < 2^53.
LIMB, BLOCK = 16, 1 << 20
#: Bits of a digit in which sums travel.
DIGIT = 64
COMPONENTS = 8
#: Eigenvalues under this share of the largest, by dimension, are rounding: their components have no variance.
NOTHING = 1e-14
_LONG = 1 << 63


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null and has neither null nor non-finite entries."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.filter(F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), entry))


def integers(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(SCALE * entry) + OFFSET of each entry, a row a vector; int64, or Python's integers where those are too
    narrow. Shorter vectors than width go on with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        full = flat.reshape(len(sizes), width)
    else:
        full = np.zeros((len(sizes), width))
        full[np.arange(width) < sizes[:, None]] = flat
    low = np.floor(full * SCALE)
    if np.abs(low).max(initial=0) < 2.0**52:
        return low.astype(np.int64) + OFFSET
    exact = np.frompyfunc(lambda v: int(v * SCALE // 1) if abs(v) < 2.0**900 else int(v) * SCALE, 1, 1)
    return exact(full) + OFFSET


def largest(x: np.ndarray) -> int:
    return int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) if x.size else 0


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: int64 where that holds it."""
    if n * largest(x) + largest(sums) < _LONG // 2 and x.dtype != object:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Slices a with y = sum of a[k] * 2^(LIMB * k), as float64: all but the last from 0 to 2^LIMB, the last signed."""
    out, mask, half = [], (1 << LIMB) - 1, 1 << (LIMB - 1)
    while True:
        if -half <= (int(y.min()) if y.size else 0) and (int(y.max()) if y.size else 0) <= half:
            return [*out, y.astype(np.float64)]
        out.append((y & mask).astype(np.float64))
        y = y >> LIMB


class Gram:
    """The Gram matrix of the rows that were added, as matrices by the places of their limbs."""

    def __init__(self, width: int):
        self.width, self.places, self.open, self.rows = width, {}, {}, 0

    def add(self, y: np.ndarray) -> None:
        """Rows of integers: float64 products of their limbs, exact as a block has at most BLOCK rows."""
        for lo in range(0, len(y), BLOCK):
            parts = limbs(y[lo : lo + BLOCK])
            stacked = np.concatenate(parts, axis=1)
            product = (stacked.T @ stacked).astype(np.int64)
            d = self.width
            for a in range(len(parts)):
                for b in range(len(parts)):
                    part = product[a * d : (a + 1) * d, b * d : (b + 1) * d]
                    if a + b in self.open:
                        self.open[a + b] += part
                    else:
                        self.open[a + b] = part.copy()
            self.rows += 1
            if self.rows % 64 == 0:  # 64 blocks of up to 2^3 products under 2^53
                self.settle()

    def settle(self) -> None:
        for k, v in self.open.items():
            self.places[k] = self.places.get(k, 0) + v.astype(object)
        self.open = {}

    def entries(self) -> list[tuple[int, int, int, int]]:
        """(i, j, place, sum) of the upper half."""
        self.settle()
        i, j = np.triu_indices(self.width)
        return [(a, b, k, v) for k, m in self.places.items() for a, b, v in zip(i.tolist(), j.tolist(), m[i, j].tolist())]


@dataclass(frozen=True)
class Whitening:
    """n and the sums of the fit list, and its components: rows of unit vectors by falling eigenvalue."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n*x - S)^2 of each row, exact; None where a long doesn't hold it."""
        y = centred(x, self.n, self.sums)
        if y.dtype != object and largest(y) ** 2 * max(1, y.shape[1]) < _LONG:
            return (y * y).sum(axis=1).tolist()
        y = y.astype(object)
        return [v if v < _LONG else None for v in (int(v) for v in (y * y).sum(axis=1))] if y.shape[1] else [0] * len(y)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows' coordinates in the components, over the root of the eigenvalue; nan without variance."""
        y = centred(x, self.n, self.sums).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y @ self.vectors.T) / np.sqrt(self.values), np.nan)


def decomposed(gram: list[list[int]], n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors as rows, eigenvalues by falling size and the trace of gram / n^3: big integers that are
    divided once, rounded as a quotient of integers is. Of either sign the one whose largest entry is positive."""
    d, cube = len(gram), max(1, n) ** 3
    v = np.array([[g / cube for g in row] for row in gram], np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    values = np.where(values > NOTHING * d * max(values.max(initial=0.0), 0.0), values, 0.0)
    turn = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)) if d else 1.0
    return vectors * turn, values, sum(gram[k][k] for k in range(d)) / cube


def digits(value: int) -> list[tuple[int, int]]:
    """(place, digit) in base 2^DIGIT, the last one signed: sums of digits fit a decimal, whatever the value."""
    out, half = [], 1 << (DIGIT - 1)
    while not -half <= value < half:
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return list(enumerate([*out, value]))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """The exact sum of `total`, integers as text, by keys."""
    return parts.groupBy(*keys).agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))


def totals(rows: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of the rows and the exact sums of their integers by dimension: one row a dimension comes to the driver."""

    def of(batches):
        n, sums = 0, np.zeros(0, object)
        for b in batches:
            x = integers(b.column(0))
            if x.shape[1] > len(sums):  # vectors so far went on with zeros
                sums = np.concatenate([sums, np.array([OFFSET * n] * (x.shape[1] - len(sums)), object)])
            part = x.sum(axis=0) if largest(x) * max(1, len(x)) < _LONG else x.astype(object).sum(axis=0)
            sums[: x.shape[1]] += part.astype(object)
            sums[x.shape[1] :] += OFFSET * len(x)
            n += len(x)
        found = [(at, place, str(v)) for at, total in enumerate((n, *sums), -1) for place, v in digits(int(total))]
        found.append((-1, -1, str(n)))
        found += [(at, -1, str(n)) for at in range(len(sums))]
        at, place, total = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(total)], ["at", "place", "total"])

    parts = merged(rows.select(vector).mapInArrow(of, "at int, place int, total string"), "at", "place")
    sums, said = {}, {}  # place -1: the rows that a dimension's sum stands for; those of shorter tasks have OFFSET in it
    for r in parts.toLocalIterator():
        if r["place"] < 0:
            said[r["at"]] = int(r["total"])
        else:
            sums[r["at"]] = sums.get(r["at"], 0) + (int(r["total"]) << (DIGIT * r["place"]))
    n = said.pop(-1, 0)
    return n, np.array([sums[k] + OFFSET * (n - said[k]) for k in sorted(said)], object)


def gram(rows: DataFrame, vector: str, n: int, sums: np.ndarray) -> list[list[int]]:
    """The exact Gram matrix of n*x - S over the rows: as many numbers as a matrix of the dimension has come to the driver,
    a few times."""
    shared = rows.sparkSession.sparkContext.broadcast((n, sums))  # a number a dimension

    def of(batches):
        n, sums = shared.value
        g = Gram(len(sums))
        for b in batches:
            g.add(centred(integers(b.column(0), len(sums)), n, sums))
        i, j, k, v = zip(*found) if (found := g.entries()) else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(map(str, v), pa.string())], ["i", "j", "place", "total"])

    parts = merged(rows.select(vector).mapInArrow(of, "i int, j int, place int, total string"), "i", "j", "place")
    out = [[0] * len(sums) for _ in sums]
    for r in parts.toLocalIterator():
        out[r["i"]][r["j"]] += int(r["total"]) << (LIMB * r["place"])
    for i in range(len(out)):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def fitted(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of usable rows, over all of them."""
    n, sums = totals(rows, vector)
    if n == 0:
        return Whitening(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0)
    vectors, values, trace = decomposed(gram(rows, vector, n, sums), n, components)
    return Whitening(n, sums, vectors, values, trace)


def projected(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation and whitened (an array, null where a component has no variance) of each usable row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # components times dimensions

    def of(batches):
        m = shared.value
        for b in batches:
            x = integers(b.column(1), len(m.sums))
            w = m.whitened(x)
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            coordinates = pa.ListArray.from_arrays(ends, pa.array(w.ravel(), pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.deviation(x), pa.int64()), coordinates], [key, "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(of, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(projections: DataFrame, model: Whitening) -> float | None:
    """Of the components with variance: the largest absolute entry of their covariance minus the identity, measured on the
    projections. Spark's covariance is a centred one: means and products around them are merged, not powers."""
    live = [k for k, e in enumerate(model.values) if e > 0]
    pairs = [(a, b) for a in live for b in live if a <= b]
    if not pairs:
        return None
    got = projections.agg(*[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]).alias(f"{a} {b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, got))


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of each usable row
    and component.

    Rows without a vector, or with a null or non-finite entry in it, are left out. Vectors shorter than the longest go
    on with zeros; a component without variance has a null coordinate and explains 0; a deviation that no long holds
    is null. A null key and repeated rows come out as they are and count in the fit; other columns aren't read. No
    usable rows, or vectors of no entries only, give no rows. Entries of over 1e140, whose covariance is no double,
    raise OverflowError."""
    bounded_batches(rows.sparkSession)
    rows = usable(rows.select(key, vector), vector)
    model = fitted(rows, vector, components)
    found = written(projected(rows, model, key, vector), "projections")
    error = identity_error(found, model)
    share = F.array([F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values]).cast("array<double>")
    out = found.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The eight strongest components of all embeddings; see whitened()."""
    return whitened(table(spark, sf_dir, "embeddings"))
