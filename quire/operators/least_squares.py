"""M1 by sufficient statistics: least squares from one pass of summed products.

A row ``z = (1, x, y)`` adds ``z z'`` to its group's matrix, so the matrix of
all folds but one is the total minus that fold's, a model without intercept is
the same matrix without its first row, and the squared error on any group is a
quadratic form of that group's matrix. Tasks sum their rows in numpy, Spark adds
the tasks' matrices (``Summarizer``, map-side partial sums); only matrices, whose
size is that of the features, reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A column whose part not explained by the columns before it is below this share
#: of its sum of squares depends on them: it gets weight 0.
DEPENDENT = 1e-9


def pack(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of symmetric matrices (last two axes)."""
    i, j = np.triu_indices(matrix.shape[-1])
    return matrix[..., i, j]


def unpack(values, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def sum_matrices(parts: DataFrame, keys: list[str], value: str = "gram") -> DataFrame:
    """Element by element sums of the arrays ``value`` of each group."""
    return (parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector(value)).alias(value))
            .withColumn(value, vector_to_array(value)))


def solve(gram: np.ndarray, fit_intercept: bool = True) -> np.ndarray:
    """Weights (intercept first) that minimise the squared error of the rows in
    ``gram``, whose first column is the constant and last the label. Gauss-Jordan
    elimination in column order; dependent columns have weight 0, and all have
    where there are no rows."""
    first = 0 if fit_intercept else 1
    size = gram.shape[0] - 1
    m = gram[first:size, first:].copy()
    scale = np.diag(m).copy()
    for k in range(len(m)):
        if m[k, k] <= DEPENDENT * scale[k]:
            m[k, :] = 0.0
            m[:, k] = 0.0
            continue
        m[k] /= m[k, k]
        others = np.arange(len(m)) != k
        m[others] -= np.outer(m[others, k], m[k])
    return np.concatenate([np.zeros(first), m[:, -1]])


def scores(gram: np.ndarray, weights: np.ndarray) -> dict:
    """``n``, ``mse`` and ``r2`` of ``weights`` on the rows summed in ``gram``."""
    n = gram[0, 0]
    z = np.append(weights, -1.0)
    error = max(float(z @ gram @ z), 0.0)
    spread = float(gram[-1, -1] - gram[0, -1] ** 2 / n) if n else 0.0
    r2 = 1.0 - error / spread if spread > 0 else float(error == 0)
    return {"n": int(n), "mse": float(error / n) if n else 0.0, "r2": float(r2)}


def row_matrix(columns) -> F.Column:
    """The packed z z' of one row as an array column, for few features."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return F.array(*[z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))])


def fold_matrices(df: DataFrame, features: list[str], label: str = "label", fold: str = "fold") -> DataFrame:
    """(``fold``, ``gram``): one aggregate for all folds, JVM only."""
    return sum_matrices(df.select(fold, row_matrix([*features, label]).alias("gram")), [fold])


def cross_validate_least_squares(df: DataFrame, features: list[str], intercepts=(True, False),
                                 label: str = "label", fold: str = "fold") -> list[dict]:
    """G2 for every intercept setting from the folds' matrices alone: rows of
    ``candidate``, ``fold``, ``n``, ``mse``, ``r2``."""
    size = len(features) + 2
    per = {r[fold]: unpack(r["gram"], size) for r in fold_matrices(df, features, label, fold).collect()}
    whole = sum(per.values())
    return [{"candidate": c, "fold": f, **scores(per[f], solve(whole - per[f], intercept))}
            for c, intercept in enumerate(intercepts) for f in sorted(per)]


def vector_matrix(df: DataFrame, features: str = "features", label: str = "label") -> tuple[np.ndarray, int]:
    """The summed z z' of a vector column and a label, and z's length; tasks sum
    their rows in numpy. Without rows: an empty matrix and 0."""
    import pyarrow as pa

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                z = np.concatenate([np.ones((len(x), 1)), x, b.column("y").to_numpy()[:, None]], axis=1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), pa.array([pack(total)], pa.list_(pa.float64()))],
                                             ["size", "gram"])
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    found = sum_matrices(rows.mapInArrow(run, "size int, gram array<double>"), ["size"]).collect()
    if not found:
        return np.zeros((0, 0)), 0
    return unpack(found[0]["gram"], found[0]["size"]), found[0]["size"]
