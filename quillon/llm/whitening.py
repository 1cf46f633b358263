"""Whitening of vectors by matrix-free block subspace iteration.

The covariance is never formed. One Spark pass over the centred fit rows gives
X'(XQ) for a block Q of a few columns; QR makes the next block, Rayleigh-Ritz gives
eigenvalues and vectors, and the iteration ends when the residuals of all components
certify them. The search space keeps the blocks that have been multiplied already (their
products are known, so they cost nothing): eigenvalues that lie as near to each other as
those of embeddings would need thousands of passes of a block that forgets them. It is
bounded by a restart from the best vectors.

What reaches the driver is dimensions x block numbers a pass, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block beyond the components asked for.
EXTRA = 8
#: A component is certified if its residual is below this share of the largest eigenvalue, near what doubles can tell.
TOLERANCE = 1e-13
#: Passes before the iteration gives up with an error.
PASSES = 200
#: Blocks that the search space holds before it restarts from the best vectors.
HELD = 12
#: Directions whose eigenvalue is below this share of the trace can't be whitened and are no components.
NOTHING = 1e-12


@dataclass(frozen=True)
class Fit:
    """n distinct rows with sums by dimension (Python integers), eigenvalues falling, unit vectors as columns, the trace, passes taken."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as whole numbers and the rest, so that rows are centred without loss."""
        return _centre(self.n, self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    base = [s // n for s in sums]
    return np.array(base, np.int64), np.array([(s - n * b) / n for s, b in zip(sums, base)])


def whole(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vectors with ``x``, the entries as floor(64 c) + 1000000; rows with a null vector or entry, or one not finite, go.

    So do rows of another length than most (of equally frequent lengths the longest stays), and empty ones.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    some = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    length = some.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length.d if length else 0
    most = F.lit(float(1 << 61))  # entries beyond it count as it, so that nothing overflows
    return some.filter(F.size(v) == d).withColumn("x", F.transform(v, lambda c: F.floor(F.greatest(-most, F.least(most, c.cast("double") * SCALE))) + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, shape: tuple[int, int], of) -> np.ndarray:
    """Sum over all rows of ``of(matrix of x)``: summed in the tasks first, then by row of the result in Spark."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)))
        # a list array by its offsets: no Python numbers are made
        offsets = pa.array(np.arange(0, total.size + 1, shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["i", "v"])

    parts = map_arrow(rows.select("x"), run, "i int, v array<double>")
    sums = parts.groupBy("i").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(shape[1])))
    out = np.zeros(shape)
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out


def multiply(rows: DataFrame, base: np.ndarray, rest: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: X'(XQ) over the centred rows, and the sum of squares by dimension."""

    def of(x: np.ndarray) -> np.ndarray:
        c = (x - base).astype(float) - rest
        return np.column_stack([c.T @ (c @ q), (c * c).sum(axis=0)])

    both = _summed(rows, (q.shape[0], q.shape[1] + 1), of)
    return both[:, :-1], both[:, -1]


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal block for the part of ``block`` outside the basis, by QR after two projections; no columns if there is none."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-10 * max(1.0, size.max(initial=0.0))]
        if not block.shape[1]:
            return block
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10 * np.abs(np.diag(r)).max()]
    return block


def subspace(multiplied, d: int, k: int, extra: int = EXTRA, tolerance: float = TOLERANCE, passes: int = PASSES, held: int = HELD, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenpairs of a symmetric d x d matrix that is known by its products: values, vectors, passes.

    ``multiplied(Q)`` is the matrix times Q, at the cost of a pass. A pair is certified if its
    residual is at most ``tolerance`` of the largest value; pairs that cannot be certified
    within ``passes`` are an error, never a silent result.
    """
    k = min(k, d)
    width = min(d, k + extra)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))
    basis, known = np.zeros((d, 0)), np.zeros((d, 0))
    for number in range(1, passes + 1):
        product = multiplied(block)
        basis, known = np.column_stack([basis, block]), np.column_stack([known, product])
        small = basis.T @ known
        values, turn = np.linalg.eigh((small + small.T) / 2)  # Rayleigh-Ritz
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, known @ turn
        residual = images[:, :k] - vectors[:, :k] * values[:k]
        if basis.shape[1] == d or (np.linalg.norm(residual, axis=0) <= tolerance * max(values[0], 0.0)).all():
            vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
            return values[:k], vectors, number
        if basis.shape[1] >= held * width:
            basis, known = vectors[:, : 2 * width], images[:, : 2 * width]
        # the images of the best vectors, as a forgetful iteration would take them; only what is new of them counts
        block = _fresh((images - vectors * values)[:, :width], basis)
        if block.shape[1] == 0:
            block = _fresh(np.random.default_rng(seed + number).standard_normal((d, width)), basis)
        block = block[:, : d - basis.shape[1]]
    raise ArithmeticError(f"components not certified in {passes} passes")


def fit(distinct: DataFrame, k: int = COMPONENTS, **options) -> Fit | None:
    """The components of distinct rows x, or None if there are none. ``distinct`` should be cut off: each pass scans it."""
    # sums of whole numbers beyond a long: decimals
    d = distinct.select(F.size("x").alias("d")).first()
    if d is None:
        return None
    d = d.d
    sums = distinct.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("x", F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(d))).first()
    n, totals = sums[0], [int(s) for s in sums[1:]]
    base, rest = _centre(n, totals)
    squares: list[np.ndarray] = []

    def multiplied(q: np.ndarray) -> np.ndarray:
        product, square = multiply(distinct, base, rest, q)
        squares[:] = [square]
        return product / n

    values, vectors, passes = subspace(multiplied, d, k, **options)
    trace = float(squares[0].sum() / n)
    # Rayleigh quotients of the certified vectors in one more pass, with the covariance of what they whiten
    keep = values > NOTHING * max(trace, 0.0)
    values, vectors = values[keep], vectors[:, keep]
    error = 0.0
    if len(values):
        white = vectors / np.sqrt(values)
        covariance = _summed(distinct, (len(values), len(values)), lambda x: (w := ((x - base).astype(float) - rest) @ white).T @ w) / n
        error = float(np.abs(covariance - np.eye(len(values))).max())
        passes += 1
    return Fit(n, totals, values, vectors, trace, passes, error)


def _deviation(x: np.ndarray, base: np.ndarray, n: int, left: np.ndarray) -> list[int | None]:
    """sum of (n x - S) squared, exact; None where it doesn't fit in a long. left: S - n base, below n."""
    away = x - base
    largest = int(np.abs(away).max(initial=0)) * n + n
    if largest * largest * x.shape[1] < 1 << 63:
        return ((n * away - left) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, left.tolist())) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, fitted: Fit, keep: list[str]) -> DataFrame:
    """Of rows with x: the columns ``keep``, deviation long, whitened array<double>, one entry a component."""
    base, rest = fitted.centre()
    n, left = fitted.n, np.array([s - fitted.n * b for s, b in zip(fitted.sums, base.tolist())], np.int64)
    white = fitted.vectors / np.sqrt(fitted.values)
    rows = vectors.select(*(F.col(f"`{c}`") for c in keep), F.col("x").alias("_quillon_x"))
    schema = rows.drop("_quillon_x").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}).schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(len(keep)))
                w = np.ascontiguousarray(((x - base).astype(float) - rest) @ white)
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)) if w.shape[1] else pa.array(np.zeros(len(x) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(_deviation(x, base, n, left), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], [*keep, "deviation", "whitened"])

    return map_arrow(rows, run, schema)


def distinct_rows(whole_rows: DataFrame) -> DataFrame:
    """Each x once, cut off. A vector that a third of all rows have leaves each map task once."""
    return cut(whole_rows.select("x").distinct())


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row that remains and component: id_col, component int, n, deviation long, whitened, explained, identity_error double.

    Rows whose vector is null, empty, holds null or non-finite entries or is of another
    length than most are left out; repeated rows and null identifiers are rows like others, but
    the fit counts each vector once. There are fewer components than k where there are fewer
    directions in which rows differ; none, and so no rows, where all are alike or there are none.
    """
    x = whole(vectors.select(F.col(f"`{id_col}`").alias("_quillon_id"), F.col(f"`{vector_col}`").alias("_quillon_vector")), "_quillon_vector").select("_quillon_id", "x")
    fitted = fit(distinct_rows(x), k)
    kind = vectors.select(F.col(f"`{id_col}`").alias(id_col)).schema[0].dataType.simpleString()
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = whiten(x, fitted, ["_quillon_id"])
    share = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values))
    return done.select("_quillon_id", "deviation", F.posexplode("whitened").alias("at", "w")).select(
        F.col("_quillon_id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(share, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component int, n, deviation long, whitened, explained, identity_error double: each vector that remains on up to 16 components."""
    return whitened(table(spark, sf_dir, "embeddings"))
