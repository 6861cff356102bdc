"""Whitening of embeddings from an exact covariance: digit-sliced products of integers.

Entries become integers x. One pass adds them up to n and S. A second pass centres each
row, y = n*x - S, cuts y into limbs of a few bits with their sign, and multiplies limbs by
float64 matrix products: a limb product summed over a block stays below 2**53, so each is
exact. The products are recombined as big integers, each task's sum is cut into digits of 40 bits, and
Spark adds digits up, combined before the shuffle; the driver gets one number for each two
dimensions and digit, whatever the number of rows. The covariance is y's second moment over n**3,
divided once as a fraction, and its eigenvectors come from numpy. A third pass projects the rows.

Values that do not fit 64 bits take the same way on Python's integers: slower, and as exact.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are
left out, as are rows of another length than the most frequent one (ties: the shortest), with
which no covariance is defined. Repeated rows and rows with the same or no vec_id count and return
each. ``deviation`` is a decimal of 38 digits, null beyond; entries beyond 1e150 in size have no
covariance in doubles and raise OverflowError. A component without variance (its
eigenvalue is below 1e-12 of the largest) has a null ``whitened`` and is not in
``identity_error``; ``explained`` is null where no dimension varies. An empty table, or one
without usable rows, gives no rows. Input columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Rows multiplied together; a power of two, for the bound on a limb's bits.
BLOCK_ROWS = 1 << 12
#: Bits of a limb: BLOCK_ROWS products of two of them stay below 2**53.
LIMB_BITS = 20
#: Bits of the digits in which tasks hand on big integers: over 2**22 tasks add up in a long.
DIGIT_BITS = 40
#: A component below this share of the largest eigenvalue has no variance.
NO_VARIANCE = 1e-12


class Sums(NamedTuple):
    """What the fit knows of all rows: their number, the length of a row, and each dimension's sum."""

    n: int
    width: int
    sums: list[int]


class Whitening(NamedTuple):
    """The fit: sums, unit eigenvectors as columns, eigenvalues falling, and their sum over all dimensions."""

    sums: Sums
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that can be whitened, each with its length."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return wide.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).withColumn("width", F.size("embedding"))


def integers(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of doubles: as int64, or as Python's integers where one needs them."""
    floors = np.floor(c * SCALE)
    if np.abs(floors).max(initial=0.0) < 2.0**62:
        return floors.astype(np.int64) + SHIFT
    exact = [int(np.floor(v * SCALE)) if np.isfinite(v * SCALE) else int(Fraction(float(v)) * int(SCALE)) for v in c.ravel()]
    return np.array([v + SHIFT for v in exact], object).reshape(c.shape)


def centred(x: np.ndarray, s: Sums) -> np.ndarray:
    """n*x - S, exact; in int64 where all of it fits."""
    most = max(int(np.abs(x).max(initial=0)), 1) * s.n + max(map(abs, s.sums))
    if most < 2**62 and x.dtype != object:
        return x * s.n - np.array(s.sums, np.int64)
    return x.astype(object) * s.n - np.array(s.sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of LIMB_BITS bits as doubles, the lowest first: y = sum of limb k times 2**(k * LIMB_BITS)."""
    sign, rest, out = np.sign(y), np.abs(y), []
    while not out or rest.any():
        out.append((sign * (rest & ((1 << LIMB_BITS) - 1))).astype(np.float64))
        rest = rest >> LIMB_BITS
    return out


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y of integers, as Python's integers: float64 products of limbs, recombined.

    Limbs k and l of all pairs with the same k + l share a weight; each product is exact on its own.
    """
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), BLOCK_ROWS):
        cut = limbs(y[start : start + BLOCK_ROWS])
        for k, a in enumerate(cut):
            for l in range(k, len(cut)):
                product = (a.T @ cut[l]).astype(np.int64).astype(object)
                out += (product if k == l else product + product.T) * (1 << (LIMB_BITS * (k + l)))
    return out


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK_ROWS rows with their entries as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part, part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _digits(values: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Big integers (i, j, value) as rows of digits; only the last digit has a sign."""
    rows, cut = [], (1 << DIGIT_BITS) - 1
    for i, j, value in values:
        place = 0
        while not -(1 << DIGIT_BITS) < value < 1 << DIGIT_BITS:
            rows.append((i, j, place, value & cut))
            value >>= DIGIT_BITS
            place += 1
        rows.append((i, j, place, value))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "digit"])


DIGITS = "i int, j int, place int, digit long"


def _added(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], int]:
    """Big integers that tasks hand on as digits, added up by Spark."""
    found = rows.mapInArrow(of, DIGITS).groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in found:
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (r.digit << (DIGIT_BITS * r.place))
    return out


def sums_of(rows: DataFrame, width: int) -> Sums:
    """n and S over all rows, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for _, c in _rows(batches, width):
            n, total = n + len(c), total + integers(c).astype(object).sum(0)
        if n:
            yield _digits([(-1, 0, n), *((0, j, int(v)) for j, v in enumerate(total))])

    found = _added(rows, partial)
    return Sums(found.get((-1, 0), 0), width, [found.get((0, j), 0) for j in range(width)])


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of usable rows of one length; None without rows."""
    lengths = rows.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not lengths:
        return None
    width = lengths[0].width
    rows = rows.where(F.col("width") == width).select("embedding")
    s = sums_of(rows, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width), object), False
        for _, c in _rows(batches, width):
            total, some = total + exact_gram(centred(integers(c), s)), True
        if some:
            yield _digits([(i, j, int(total[i, j])) for i in range(width) for j in range(i, width)])

    gram = _added(rows, partial)
    cube = s.n**3
    covariance = np.empty((width, width))
    for (i, j), value in gram.items():
        covariance[i, j] = covariance[j, i] = float(Fraction(value, cube))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # The largest entry of each vector is positive, so that reruns agree.
    heavy = vectors[np.abs(vectors).argmax(0), np.arange(width)]
    trace = float(Fraction(sum(gram[i, i] for i in range(width)), cube))
    return Whitening(s, vectors * np.where(heavy < 0, -1.0, 1.0), np.maximum(values, 0.0), trace)


def _projected(c: np.ndarray, w: Whitening, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers of a block, and its rows on the first k components, each over its root of variance."""
    y = centred(integers(c), w.sums)
    exact = y.astype(np.float64) if y.dtype != object else np.array([float(Fraction(int(v), 1)) for v in y.ravel()]).reshape(y.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        return y, (exact / w.sums.n) @ w.vectors[:, :k] / np.sqrt(w.values[:k])


def _alive(w: Whitening, k: int) -> np.ndarray:
    return w.values[:k] > NO_VARIANCE * w.values[0]


def identity_error(rows: DataFrame, w: Whitening, k: int) -> float | None:
    """Largest absolute entry of the covariance of whitened rows minus the identity, measured on all rows."""
    alive = np.flatnonzero(_alive(w, k))
    if not len(alive):
        return None
    width = w.sums.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, some = np.zeros(len(alive)), np.zeros((len(alive), len(alive))), False
        for _, c in _rows(batches, width):
            z = _projected(c, w, k)[1][:, alive]
            first, second, some = first + z.sum(0), second + z.T @ z, True
        if some:
            full = np.vstack([first, second])
            i, j = np.divmod(np.arange(full.size), len(alive))
            yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(full.ravel())], names=["i", "j", "value"])

    found = rows.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    first, second = np.zeros(len(alive)), np.zeros((len(alive), len(alive)))
    for r in found:
        if r.i < 0:
            first[r.j] = r.value / w.sums.n
        else:
            second[r.i, r.j] = r.value / w.sums.n
    return float(np.abs(second - np.outer(first, first) - np.eye(len(alive))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(vectors)
    w = fit(rows)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, n = w.sums.width, w.sums.n
    rows = rows.where(F.col("width") == width).select("vec_id", "embedding")
    k = min(components, width)
    error = identity_error(rows.select("embedding"), w, k)
    dead = ~_alive(w, k)
    explained = [float(v) / w.trace if w.trace else None for v in w.values[:k]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c in _rows(batches, width):
            y, z = _projected(c, w, k)
            narrow = y.dtype != object and width * int(np.abs(y).max(initial=0)) ** 2 < 2**63
            squares = (y if narrow else y.astype(object)) ** 2 @ np.ones(width, np.int64 if narrow else object)
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares.tolist()], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(c)), k))
            arrays = [
                part.column("vec_id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))), pa.array(np.full(len(c) * k, n)), deviation.take(each),
                pa.array(z.ravel(), mask=np.tile(dead, len(c))), pa.array(explained * len(c), pa.float64()), pa.array([error] * (len(c) * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
