"""A linear probe with soft targets: all classes at once, by full-batch Adam.

A step needs the gradient over all rows: a sum of classes x (dimensions + 1) numbers,
taken in the tasks and then by Spark. Tables that fit a bound come to the driver once, where
the same steps run in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import cut

#: Numbers (rows x (dimensions + classes)) up to which the steps run on the driver.
DRIVER_NUMBERS = 4_000_000
#: Vectors are scaled by this before the linear layer.
SCALE = 10.0


@dataclass
class Probe:
    """Weights (classes x dimensions), biases, and the loss before each step."""

    weights: np.ndarray
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x * SCALE @ self.weights.T + self.bias)))


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One row a class: its part of the summed loss, the gradient by weight, the gradient by bias. Sums over rows, means over classes."""
    z = x * SCALE @ weights.T + bias
    loss = (np.logaddexp(0, z) - y * z) * w[:, None] / y.shape[1]
    away = (1 / (1 + np.exp(-z)) - y) * w[:, None] / y.shape[1]
    return np.column_stack([loss.sum(axis=0), away.T @ x * SCALE, away.sum(axis=0)])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _pass(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """loss_and_gradient over all rows, summed in the tasks first."""
    classes, width = weights.shape[0], weights.shape[1] + 2
    scale = SCALE

    def run(batches):
        total = np.zeros((classes, width))
        for batch in batches:
            if batch.num_rows:
                x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1) for c in (batch.column(0), batch.column(1)))
                w = batch.column(2).to_numpy(zero_copy_only=False)
                z = x * scale @ weights.T + bias
                away = (1 / (1 + np.exp(-z)) - y) * w[:, None] / classes
                total += np.column_stack([((np.logaddexp(0, z) - y * z) * w[:, None] / classes).sum(axis=0), away.T @ x * scale, away.sum(axis=0)])
        offsets = pa.array(np.arange(0, total.size + 1, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["i", "v"])

    sums = rows.select("x", "y", "w").mapInArrow(run, "i int, v array<double>").groupBy("i").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width)))
    out = np.zeros((classes, width))
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out


def fit_soft_probe(rows: DataFrame, epochs: int = 300, decay: float = 1e-4, rate: float = 1e-2, driver_numbers: int = DRIVER_NUMBERS) -> Probe | None:
    """Fit rows(x array<double>, y array<double>: a target from 0 to 1 for each class, w): binary cross-entropy, weighted mean.

    Weights begin at 0, as the loss is convex; ``decay`` times their squares is added. Rows
    with a null, and of other lengths than the first, are left out by the caller; no rows, no probe.
    """
    data = cut(rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), F.col("w").cast("double").alias("w")))
    first = data.select(F.size("x").alias("d"), F.size("y").alias("k")).first()
    if first is None:
        return None
    n, d, k = data.count(), first.d, first.k
    if n * (d + k) <= driver_numbers:
        t = data.toArrow()
        x, y, w = _matrix(t["x"]), _matrix(t["y"]), t["w"].to_numpy()
        step = lambda weights, bias: loss_and_gradient(x, y, w, weights, bias)
    else:
        step = lambda weights, bias: _pass(data, weights, bias)
    at, losses = np.zeros((k, d + 1)), []
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for number in range(1, epochs + 1):
        sums = step(at[:, :-1], at[:, -1]) / n
        losses.append(float(sums[:, 0].sum() + decay * (at[:, :-1] ** 2).sum()))
        gradient = sums[:, 1:]
        gradient[:, :-1] += 2 * decay * at[:, :-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        at = at - rate * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.999**number)) + 1e-8)
    return Probe(at[:, :-1], at[:, -1], losses)


def probe_scores(vectors: DataFrame, probe: Probe, classes: list[str], keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` and probs, a map of class to probability, of every vector."""
    weights, bias, scale = probe.weights, probe.bias, SCALE
    own = vectors.select(*keep, F.col(vector).cast("array<double>").alias("_x"))
    schema = own.drop("_x").withColumn("_p", F.lit(None).cast("array<double>")).schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = batch.column(len(keep))
                x = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
                p = 1 / (1 + np.exp(-(x * scale @ weights.T + bias)))
                offsets = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p).ravel()))], names=schema.names)

    scored = own.mapInArrow(run, schema)
    return scored.select(*keep, F.map_from_arrays(F.array(*map(F.lit, classes)), "_p").alias("probs"))
