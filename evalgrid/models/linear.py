"""Linear baselines on array features, fitted from moments that Spark sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    """Prediction ``intercept + coefficients . x``."""

    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, features: Column | str) -> Column:
        """The dot product as a JVM expression."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        products = F.zip_with(features, weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda s, v: s + v)


#: Features up to which one matrix of products is summed; beyond it each product with a vector is a pass.
DENSE = 512


def _rows(df: DataFrame, features: str, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull() & ~F.isnan(target)).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch as rows, from their flat buffer."""
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of an array made of a batch's features and targets, added up in ranges of SPAN numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = parts(_matrix(batch), batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            at = range(0, total.size, SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[i : i + SPAN].tolist() for i in at])], ["at", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = np.stack([p.values.to_numpy() for p in group["part"]]).sum(axis=0)
        return pa.table({"at": group["at"].slice(0, 1), "part": pa.array([total])})

    found = rows.mapInArrow(run, "at long, part array<double>").groupBy("at").applyInArrow(add, "at long, part array<double>").toArrow().sort_by("at")
    if not found.num_rows:
        raise ValueError("no rows with a target")
    return found["part"].combine_chunks().flatten().to_numpy()


SPAN = 1 << 14


class Products:
    """Centred sums of products of features and target: ``xy``, the diagonal ``xx``, and ``times(v)``, the matrix with a vector.

    Up to DENSE features the matrix is summed in one pass of DENSE ** 2 numbers at most; beyond
    that each ``times`` is a pass that sums as many numbers as there are features.
    """

    def __init__(self, df: DataFrame, features: str, target: str):
        self.rows = _rows(df, features, target)
        sums = _summed(self.rows, lambda x, y: np.concatenate([[len(y), y.sum(), y @ y], x.sum(axis=0), (x * x).sum(axis=0), y @ x]))
        d = (sums.size - 3) // 3
        self.n, self.y, yy = float(sums[0]), sums[1] / sums[0], sums[2]
        self.mean = sums[3 : 3 + d] / self.n
        self.yy = yy - self.n * self.y**2
        self.xx = sums[3 + d : 3 + 2 * d] - self.n * self.mean**2
        self.xy = sums[3 + 2 * d :] - self.n * self.mean * self.y
        self.matrix = None
        if d <= DENSE:
            whole = _summed(self.rows, lambda x, y: (x.T @ x).ravel()).reshape(d, d)
            self.matrix = whole - self.n * np.outer(self.mean, self.mean)

    def times(self, v: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix @ v
        return _summed(self.rows, lambda x, y: (x @ v) @ x) - self.n * self.mean * float(self.mean @ v)


def fit_ridge(df: DataFrame, features: str, target: str, alpha: float = 1.0, steps: int = 500) -> Linear:
    """Ridge regression with an intercept that is not penalised: solved at once, or by conjugate gradients where features are many."""
    p = Products(df, features, target)
    if p.matrix is not None:
        w = np.linalg.solve(p.matrix + alpha * np.eye(p.mean.size), p.xy)
    else:
        w, r = np.zeros(p.mean.size), p.xy.copy()
        q, size = r.copy(), float(r @ r)
        goal = 1e-20 * size
        for _ in range(steps):
            if size <= goal:
                break
            along = p.times(q) + alpha * q
            a = size / float(q @ along)
            w, r = w + a * q, r - a * along
            size, before = float(r @ r), size
            q = r + size / before * q
        else:
            raise RuntimeError(f"conjugate gradients did not settle in {steps} steps")
    return Linear(tuple(w.tolist()), float(p.y - w @ p.mean))


def fit_pls(df: DataFrame, features: str, target: str, components: int = 2) -> Linear:
    """Partial least squares for one target; features and target are centred and scaled by sample deviations.

    A deflated cross product gives each weight vector; a component takes one product of the matrix
    with a vector.
    """
    p = Products(df, features, target)
    free = max(p.n - 1, 1)
    std, std_y = np.sqrt(np.maximum(p.xx / free, 0)), float(np.sqrt(max(p.yy / free, 0)))
    std[std < 1e-12] = 1.0
    std_y = 1.0 if std_y < 1e-12 else std_y
    left = p.xy / free / std / std_y
    weights, loadings, shares, sizes = [], [], [], []
    for _ in range(min(components, left.size)):
        size = np.linalg.norm(left)
        if size < 1e-12:
            break
        w = left / size
        along = p.times(w / std) / free / std
        for q, t in zip(loadings, sizes, strict=True):
            along = along - t * q * float(q @ w)
        t = float(w @ along)
        if t < 1e-15:
            break
        q, share = along / t, float(left @ w) / t
        weights.append(w)
        loadings.append(q)
        shares.append(share)
        sizes.append(t)
        left = left - t * share * q
    b = np.zeros(left.size)
    if weights:
        w, q = np.array(weights).T, np.array(loadings).T
        b = w @ np.linalg.solve(q.T @ w, np.array(shares)) * std_y / std
    return Linear(tuple(b.tolist()), float(p.y - b @ p.mean))


MODELS = {"pls": fit_pls, "ridge": fit_ridge}
