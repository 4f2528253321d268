"""M1 for models wider than a driver holds: limited-memory quasi-Newton by rows.

A model of a number per term needs some 25 vectors of that width on the driver
when Spark fits it. Here no vector of the model's width exists outside the tasks.
Every vector the method meets is a sum of rows of the scaled matrix X, so it is
kept as that sum's weights, a number per row, and as its product with X, a number
per row too; inner products follow from these. One pass a step gives X X' r for
the residuals r: cells lie by column in blocks, a task adds up a column's
products with r and scatters them to the rows again. Of the vectors by row only
the present ones (residuals, their products, the fit) are in the driver's memory
and sent to the tasks, the remembered ones are in a file.

Method, step search and stopping rules are those of Spark's ``l-bfgs`` solver
(columns and label divided by their deviations, columns without one left out), so
both take the same steps.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.hot_join import hot_join
from quire.operators.least_squares import sum_matrices
from quire.operators.rows import deal_by
from quire.session import ship_package, shuffles_removed, stored

#: Up to this width Spark solves the normal equations, whose matrix is bounded.
WIDEST_NORMAL = 4096
#: Cells of a block of columns; rows of a piece of a vector by row.
BLOCK_CELLS, PIECE = 1 << 20, 1 << 16
#: Remembered steps, most steps, tolerance: Spark's.
MEMORY, MOST_STEPS, TOLERANCE = 10, 100, 1e-6
#: What a column's weight takes in a broadcast.
WEIGHT_ROW_BYTES = 64


class SearchFailed(Exception):
    """No step along a direction meets the conditions."""


def _between(left: tuple, right: tuple) -> float:
    """The least place of the cubic through two (place, value, slope)."""
    (lt, lf, ld), (rt, rf, rd) = left, right
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    d2 = math.sqrt(max(0.0, d1 * d1 - ld * rd))
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    return min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt))


def step_length(phi: Callable[[float], tuple[float, float]], t: float) -> float:
    """A step that meets the strong Wolfe conditions; ``phi`` gives value and slope."""
    c1, c2 = 1e-4, 0.9

    def at(t):
        return (t, *phi(t))
    low = at(0.0)
    _, value, slope = low
    if slope > 0:
        raise SearchFailed

    def zoom(low, high):
        for _ in range(10):
            c = at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed
    for i in range(10):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed


class _Remembered:
    """Steps s and changes y of the gradient, each as (weights by row, product with
    X), in a file; the weights of y are X s / n. Their inner products."""

    def __init__(self, n: int, folder: str):
        self.n = n
        self.file = np.memmap(f"{folder}/steps", np.float64, "w+", shape=(3 * MEMORY, n))
        self.slots: list[int] = []  # newest first

    def add(self, weights: np.ndarray, xs: np.ndarray, xy: np.ndarray) -> None:
        slot = next(i for i in range(MEMORY) if i not in self.slots[:MEMORY - 1])
        self.slots = [slot, *self.slots[:MEMORY - 1]]
        for j, v in enumerate((weights, xs, xy)):
            self.file[3 * slot + j] = v

    def direction(self, r: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minus the approximate inverse Hessian times the gradient X' r / n, whose
        product with X is ``u``."""
        n, k = self.n, len(self.slots)
        s = [self.file[3 * i] for i in self.slots]
        xs = [self.file[3 * i + 1] for i in self.slots]
        xy = [self.file[3 * i + 2] for i in self.slots]
        sy = np.array([[a @ b / n for b in xs] for a in xs]).reshape(k, k)  # [i, j]: s i, y j
        yy = np.array([[a @ b / n for b in xy] for a in xs]).reshape(k, k)
        sg, yg = np.array([r @ a / n for a in xs]), np.array([a @ u / n for a in xs])
        if k and not sy[0, 0] >= 0:
            raise SearchFailed
        # the direction is scale * (g + y @ cy) + s @ cs
        scale, cy, cs, a = (sy[0, 0] / yy[0, 0] if k else 1.0), np.zeros(k), np.zeros(k), np.zeros(k)
        for i in range(k):
            a[i] = (sg[i] + sy[i] @ cy) / sy[i, i]
            if math.isnan(a[i]):
                raise SearchFailed
            cy[i] -= a[i]
        for i in range(k - 1, -1, -1):
            cs[i] = a[i] - (scale * (yg[i] + yy[i] @ cy) + sy[:, i] @ cs) / sy[i, i]
        weights, image = scale * r / n, scale * u
        for i in range(k):
            weights += scale * cy[i] * xs[i] / n + cs[i] * s[i]
            image += scale * cy[i] * xy[i] + cs[i] * xs[i]
        return -weights, -image


def fit_by_rows(product: Callable[[np.ndarray], np.ndarray], label: np.ndarray) -> np.ndarray:
    """The fitted model as weights by row; ``product`` gives X X' r."""
    n = len(label)
    r, fitted = -label, np.zeros(n)
    u = product(r) / n
    values, value = [math.inf], r @ r / (2 * n)
    first, failed = value, False
    with tempfile.TemporaryDirectory(prefix="quire-fit-") as folder:
        known, step = _Remembered(n, folder), 0
        while True:
            slope = math.sqrt(max(0.0, r @ u / n))
            if step >= MOST_STEPS or slope <= max(TOLERANCE * value, 1e-8) or (
                    len(values) >= 2 and abs(value - max(values)) <= TOLERANCE * abs(first)):
                return fitted
            try:
                weights, q = known.direction(r, u)
                size = math.sqrt(max(0.0, n * (weights @ q)))  # |X' w|^2 = w' X X' w
                t = step_length(lambda t: ((r + t * q) @ (r + t * q) / (2 * n), (r + t * q) @ q / n), 1.0 if step else 1.0 / slope)
                if t * slope < 1e-10 or not math.isfinite(size):
                    raise SearchFailed
            except SearchFailed:
                if failed:
                    return fitted
                known.slots, failed = [], True
                continue
            fitted += t * weights
            r = r + t * q
            new = product(r) / n
            known.add(t * weights, t * q, new - u)
            u, value, failed, step = new, r @ r / (2 * n), False, step + 1
            values = [*values, value][-20:]


def _block(n: int, shared):
    """One row of a block's cells: its columns, where their cells start, the square
    of what divides a column, its sum; rows and values of the cells. Rows are places
    of the id in the sorted ``shared`` ids; cells of other ids are left out."""
    def run(table: pa.Table) -> pa.Table:
        idx, key, x = (table.column(c).to_numpy() for c in ("idx", "key", "value"))
        first, last = (np.searchsorted(shared.value, key, side=s) for s in ("left", "right"))
        times = last - first
        idx, x, row = np.repeat(idx, times), np.repeat(x, times), np.repeat(first, times)
        row = row + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        if not len(idx):
            return pa.table({c: pa.array([], k) for c, k in zip(_FIELDS, map(pa.list_, _KINDS))})
        order = np.argsort(idx, kind="stable")
        idx, row, x = idx[order], row[order], x[order].astype(np.float64)
        starts = np.flatnonzero(np.diff(idx, prepend=idx[0] - 1))
        total = np.add.reduceat(x, starts)
        variance = np.maximum(np.add.reduceat(x * x, starts) - total * total / n, 0.0) / max(n - 1, 1)
        # a column that is the same in all rows differs from that by rounding only
        variance[variance <= 1e-14 * np.add.reduceat(x * x, starts) / n] = 0.0
        parts = [idx[starts], starts, variance, total, row, x]
        return pa.table({c: pa.array([p], pa.list_(k)) for c, p, k in zip(_FIELDS, parts, _KINDS)})
    return run


_KINDS = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
_FIELDS = ("idx", "starts", "variance", "total", "row", "x")
_BLOCK = "idx array<bigint>, starts array<int>, variance array<double>, total array<double>, row array<int>, x array<double>"


def _columns(batches, r: np.ndarray):
    """Of each block its arrays and, divided by a column's variance, the columns' products with ``r``."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in _FIELDS}
            p = np.add.reduceat(part["x"] * r[part["row"]], part["starts"])
            yield part, np.divide(p, part["variance"], out=np.zeros_like(p), where=part["variance"] > 0)


@dataclass
class WideModel:
    """``weights`` (idx, w, n) and the intercept."""
    weights: DataFrame
    intercept: float

    def predict(self, rows: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
        """``rows`` with their ``prediction``; rows without known features get the intercept."""
        met = hot_join(features.select(id_col, "idx", "value"), self.weights, "idx", "n", WEIGHT_ROW_BYTES, id_col)
        sums = met.groupBy(id_col).agg(F.sum(F.col("value") * F.col("w")).alias("_sum"))
        return rows.join(sums, id_col, "left").withColumn(
            "prediction", F.coalesce("_sum", F.lit(0.0)) + F.lit(self.intercept)).drop("_sum")


def fit_wide(rows: DataFrame, features: DataFrame, id_col: str, label_col: str = "label") -> WideModel:
    """Least squares with intercept of ``rows`` (id, label) on the written ``features``
    (id, idx, value), which may have cells of other ids."""
    spark = rows.sparkSession
    ship_package(spark)
    # Ids and labels of the rows are on the driver and sent to the tasks, so cells
    # are moved to their block only, not to their row before.
    labels = rows.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("y")).orderBy("key").toArrow()
    n = labels.num_rows
    if not n:
        raise ValueError("no rows to fit")
    y = labels.column("y").to_numpy()
    nulls = labels.column("key").null_count  # these come first and have no cells
    y = np.concatenate([y[nulls:], y[:nulls]])
    keys = spark.sparkContext.broadcast(labels.column("key").slice(nulls).to_numpy())
    mean, deviation = y.mean(), (y.std(ddof=1) if n > 1 else 0.0)
    cells = features.where(F.col("idx").isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("key"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    n_cells = cells.count()
    n_blocks = max(1, math.ceil(n_cells / BLOCK_CELLS), min(4 * spark.sparkContext.defaultParallelism, n_cells >> 14))
    block = F.pmod(F.xxhash64("idx"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = stored(deal_by(cells.select("key", "idx", "value", block), "block").groupBy("block").applyInArrow(_block(n, keys), _BLOCK), "fit-blocks")

    def product(r: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(r)

        def run(batches):
            r, out, some = shared.value, np.zeros(n), False
            for part, p in _columns(batches, r):
                lengths = np.diff(np.append(part["starts"], len(part["x"])))
                out += np.bincount(part["row"], part["x"] * np.repeat(p, lengths), n)
                some = True
            for lo in range(0, n if some else 0, PIECE):
                piece = out[lo:lo + PIECE]
                yield pa.RecordBatch.from_arrays([pa.array([lo // PIECE], pa.int32()), pa.array([piece], pa.list_(pa.float64()))], ["piece", "sums"])
        with shuffles_removed(spark):
            found = sum_matrices(blocks.mapInArrow(run, "piece int, sums array<double>"), ["piece"], "sums").toArrow()
        shared.destroy()
        out = np.zeros(n)
        for piece, sums in zip(found.column("piece").to_pylist(), found.column("sums")):
            out[piece * PIECE:(piece + 1) * PIECE] = sums.values.to_numpy(zero_copy_only=False)
        return out - out.mean()  # columns are centred, and so are the residuals
    scaled = (y - mean) / deviation if deviation > 0 else np.zeros(n)
    shared = spark.sparkContext.broadcast(fit_by_rows(product, scaled) * deviation)

    def weigh(batches):
        for part, w in _columns(batches, shared.value):
            n_rows = np.diff(np.append(part["starts"], len(part["x"])))
            yield pa.RecordBatch.from_arrays([pa.array(part["idx"]), pa.array(w), pa.array(n_rows.astype(np.int64)), pa.array(part["total"] / n * w)],
                                             ["idx", "w", "n", "at_mean"])
    weights = stored(blocks.mapInArrow(weigh, "idx long, w double, n long, at_mean double"), "fit-weights")
    at_mean = weights.agg(F.sum("at_mean")).first()[0] or 0.0
    return WideModel(weights.select("idx", "w", "n"), float(mean - at_mean))
