"""Whitening of embeddings by shifted CholeskyQR.

* **Integers.** Every entry c, as double, becomes x = floor(256 c). The fit list is each distinct x vector once; its sums
  are whole numbers, exact at any size.
* **Passes.** Let A be the fit list less its means. Tasks form Q = A inv(R1) inv(R2) ... by a triangular solve per
  factor found so far, and add up the Gram matrix of Q: one number per cell and task, summed by Spark, so that the driver
  gets dims^2 / 2 numbers. The Cholesky factor of that Gram matrix is the next R. The first pass, and any later one
  whose Gram matrix is not yet well conditioned, adds a shift in the size of the rounding error, which keeps the
  factorisation possible whatever the condition of A, and the next pass takes the distortion out again.
  Passes end when Q is orthonormal to rounding error, but for directions without variance.
* **Components.** R = ... R2 R1 has the singular values of A: its SVD gives the eigenvectors of the covariance and the
  eigenvalues s^2 / n, without squaring the condition number.
* **Check.** One more pass over the fit list takes the covariance of the whitened values, centred before multiplying, and
  its largest deviation from the identity.

Vectors that are null or hold null or non-finite entries take no part; of vectors of other lengths only those of the
commonest length do (of equally common ones the longest; empty vectors do not count). Entries beyond 64-bit whole
numbers after the product are held at their ends. Repeated rows and rows with a null or repeated vec_id are rows of their
own; each distinct vector enters the fit once. A component without variance (fewer distinct vectors than dimensions, a
constant dimension) has explained 0 and null whitened values; it does not count for the identity error, which is null where
no component has variance. Components of equal variance: any basis of their space. An empty table gives no rows.
Other columns are ignored.
"""

from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.plans.runtime import Scratch

SCALE = 256
COMPONENTS = 4
MAX_PASSES = 8
EPS = float(np.finfo(np.float64).eps)
# rows a task holds as doubles at once
ROWS = 4096


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part; x as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    end = float(2 ** 63)
    whole = lambda c: (F.when(F.floor(c * SCALE) >= end, F.lit(2 ** 63 - 1))
                       .when(c * SCALE <= -end, F.lit(-2 ** 63)).otherwise(F.floor(c * SCALE)))
    # a flat list of whole numbers; "+0" is implied, whole numbers have no negative zero
    return rows.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(batches, dims: int):
    """Sum per dimension, exact: whole numbers of 64 bits where they surely suffice, else of any size."""
    total, rows = [0] * dims, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            top = max(abs(int(x.min())), abs(int(x.max())))
            part = x.sum(axis=0) if top * len(x) < 2 ** 62 else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
            rows += len(x)
    if rows:
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([-1, *range(dims)], pa.int32()),
            "total": pa.array([Decimal(rows), *map(Decimal, total)], pa.decimal128(38, 0))})


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular ``r``, column by column."""
    q = np.array(rows, dtype=np.float64, order="F")
    for j in range(r.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ r[:j, j]
        q[:, j] /= r[j, j]
    return q


class Centre:
    """Means of the fit list; ``apply`` subtracts them from whole numbers without a rounded mean's error."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([min(max(s // n, -2 ** 62), 2 ** 62) for s in sums], dtype=np.int64)
        self.rest = np.array([float(Decimal(s - int(f) * n) / n) for s, f in zip(sums, self.floor)])

    def apply(self, x: np.ndarray) -> np.ndarray:
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) >= 2 ** 61:
            return (x.astype(object) - self.floor).astype(np.float64) - self.rest
        return (x - self.floor).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        top = max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1
        spread = self.n * top + max(map(abs, self.sums))
        if spread ** 2 * x.shape[1] < 2 ** 62:
            return ((x * self.n - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()


def _rows_of(batches, column: int = 0):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(column))


def _gram(batches, shared, factors):
    """Cells of the upper triangle of the Gram matrix of the orthogonalised rows of one task."""
    centre, total = shared.value, None
    for _, x in _rows_of(batches):
        q = centre.apply(x)
        for r in factors:
            q = solve(q, r)
        total = q.T @ q if total is None else total + q.T @ q
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                          "value": pa.array(total[i, j], pa.float64())})


def _total(cells: DataFrame, dims: int) -> np.ndarray:
    out = np.zeros((dims, dims))
    for r in cells.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # dims^2 / 2 numbers
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def next_factor(gram: np.ndarray, n: int, first: bool) -> tuple[np.ndarray, bool]:
    """(R, done): the Cholesky factor, with a shift where needed, and whether Q was orthonormal already.

    Directions without variance stay near zero in Q and are no reason to go on.
    """
    dims = len(gram)
    values = np.linalg.eigvalsh(gram)
    tolerance = 64 * EPS * (n ** 0.5 + dims)
    if not first:
        live = values > 0.5
        if np.all(np.abs(values[live] - 1) < tolerance) and np.all(values[~live] < 1e-2):
            return np.eye(dims), True
    shift = 11 * (n * dims + dims * (dims + 1)) * EPS / 2 * max(values[-1], 0.0)
    # a larger shift than this one only slows the passes down
    shift = min(shift, 1e-6 * max(values[-1], 0.0)) or 1.0
    if first or values[0] < 1e-3:
        gram = gram + shift * np.eye(dims)
    while True:
        try:
            return np.linalg.cholesky(gram).T, False
        except np.linalg.LinAlgError:  # rounding error above the shift
            shift *= 16
            gram = gram + shift * np.eye(dims)


class Whitening:
    """Means, eigenvectors (columns) and eigenvalues of the fit list."""

    def __init__(self, centre: Centre, r: np.ndarray, k: int):
        _, s, vt = np.linalg.svd(r)
        live = s > s[0] * max(len(s) ** 0.5, 1) * 1e-12 if s[0] > 0 else np.zeros(len(s), dtype=bool)
        self.centre, values = centre, np.where(live, s, 0.0) ** 2 / centre.n
        k = min(k, len(values))
        vectors = vt[:k].T
        sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)])
        self.values, self.vectors = values[:k], vectors * np.where(sign == 0, 1, sign)
        total = values.sum()
        self.explained = self.values / total if total > 0 else np.zeros(k)
        self.root = np.sqrt(self.values)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.root > 0, (self.centre.apply(x) @ self.vectors) / self.root, np.nan)


def _moments(batches, shared):
    """Sums (j = -1) and products of the whitened fit rows of one task."""
    model, total, square = shared.value, 0.0, 0.0
    seen = False
    for _, x in _rows_of(batches):
        w = np.nan_to_num(model.apply(x))
        total, square, seen = total + w.sum(axis=0), square + w.T @ w, True
    if seen:
        k = len(total)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([*range(k), *i], pa.int32()), "j": pa.array([-1] * k + [*j], pa.int32()),
            "value": pa.array([*total, *square[i, j]], pa.float64())})


def _whiten(batches, shared):
    model = shared.value
    k = len(model.values)
    for part, x in _rows_of(batches, 1):
        w = model.apply(x)
        flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
        offsets = pa.array(np.arange(0, len(x) * k + 1, k), pa.int32())
        deviation = pa.array([Decimal(d) if d < 10 ** 38 else None for d in model.centre.deviation(x)],
                             pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), deviation, pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    shared = fit.sparkSession.sparkContext.broadcast(model)
    cells = {(r.i, r.j): r.value for r in fit.mapInArrow(
        partial(_moments, shared=shared), "i int, j int, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")).collect()}  # at most k^2 numbers
    n, live = model.centre.n, [c for c in range(len(model.values)) if model.values[c] > 0]
    errors = [abs(cells[i, j] / n - cells[i, -1] / n * (cells[j, -1] / n) - (i == j))
              for i in live for j in live if i <= j]
    return float(max(errors)) if errors else None


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    ``deviation`` is a whole number of up to 38 digits (null beyond). Fits when called.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    every = scaled(vectors)
    sizes = every.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    dims = sizes.dims
    every = every.filter(F.size("x") == dims)
    with Scratch(spark) as scratch:
        fit = scratch.settle(every.select("x").distinct())
        total = {r.dim: int(r.total) for r in fit.mapInArrow(
            partial(_sums, dims=dims), "dim int, total decimal(38,0)").groupBy("dim").agg(
            F.sum("total").alias("total")).collect()}  # dims + 1 numbers
        centre = Centre(total[-1], [total[d] for d in range(dims)])
        shared, factors, whole = spark.sparkContext.broadcast(centre), [], np.eye(dims)
        for step in range(MAX_PASSES):
            gram = _total(fit.mapInArrow(partial(_gram, shared=shared, factors=list(factors)),
                                         "i int, j int, value double"), dims)
            if not gram.any():
                whole = np.zeros((dims, dims))  # one distinct vector: no variance at all
                break
            r, done = next_factor(gram, centre.n, step == 0)
            if done:
                break
            factors.append(r)
            whole = r @ whole
        model = Whitening(centre, whole, components)
        error = _identity_error(fit, model)
    shared = spark.sparkContext.broadcast(model)
    each = every.mapInArrow(partial(_whiten, shared=shared),
                            f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    return each.select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("c") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
