"""N-gram convolution with global max pooling.

Filters of width k (1, 2, 3; 20 each by default), stride 1, ReLU, then the
maximum over all window positions of a padded sequence of length ``maxlen``.

A window's sum before the activation is ``b_f + sum_j vec(word at t+j) . W[k,f,j]``.
The dot product depends only on (word, k, f, j), so it is computed once per
vocabulary word that has a vector (a numpy matrix product inside ``mapInPandas``
over the partitioned vocabulary). A document stays one row and meets its words'
projections in place (``in_place``); each such word scatters its parts to the
windows it stands in, and the best window is kept. A window without such a word
sums to 0, as padding does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.in_place import float_lists, map_sequences
from quire.session import stored

BRANCHES = (1, 2, 3)
N_FILTERS = 20


@dataclass
class ConvFilters:
    """Weights of the three branches: ``w[k]`` has shape (k, dim, n_filters)."""
    w: dict
    b: dict
    dim: int
    n_filters: int = N_FILTERS
    branches: tuple = BRANCHES

    @property
    def n_slots(self) -> int:
        return sum(k * self.n_filters for k in self.branches)

    def slot_matrix(self) -> np.ndarray:
        """(dim, n_slots): columns ordered by branch, then slot j, then filter."""
        cols = [self.w[k][j] for k in self.branches for j in range(k)]
        return np.concatenate(cols, axis=1)

    def slot(self, k: int, j: int, f: int) -> int:
        base = 0
        for kk in self.branches:
            if kk == k:
                return base + j * self.n_filters + f
            base += kk * self.n_filters
        raise KeyError(k)


def rule_filters(dim: int, n_filters: int = N_FILTERS, branches=BRANCHES) -> ConvFilters:
    """Deterministic filters for checks: w = ((7f + 5j + 3d + k) mod 11 - 5) / 10,
    b = ((f + k) mod 5 - 2) / 10."""
    w, b = {}, {}
    d = np.arange(dim)[:, None]
    f = np.arange(n_filters)[None, :]
    for k in branches:
        w[k] = np.stack([(((7 * f + 5 * j + 3 * d + k) % 11) - 5) / 10.0 for j in range(k)])
        b[k] = ((np.arange(n_filters) + k) % 5 - 2) / 10.0
    return ConvFilters(w, b, dim, n_filters, tuple(branches))


def slot_projections(matrix: DataFrame, filters: ConvFilters) -> DataFrame:
    """(idx, cnt, proj array<double>): each known word's dot products with every
    filter slot. Rows without a vector are left out (they project to 0)."""
    wmat = filters.slot_matrix()

    def project(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            proj = vecs @ wmat
            yield pd.DataFrame({"idx": pdf["idx"].to_numpy(), "cnt": pdf["cnt"].to_numpy(), "proj": list(proj)})

    known = matrix.where("known").select("idx", "cnt", "vec")
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("cnt", T.LongType()),
                           T.StructField("proj", T.ArrayType(T.DoubleType()))])
    return stored(known.mapInPandas(project, schema), "word-projections")


def conv_pool(seqs: DataFrame, proj: DataFrame, filters: ConvFilters, id_col: str,
              maxlen: int = 400, seq_col: str = "seq", frequency: str = "cnt") -> DataFrame:
    """(id, ``pooled``) for every document of ``seqs``: an array with a
    value per width and filter, widths first.

    ``seqs`` holds the kept (truncated, unpadded) index sequences, length
    <= ``maxlen``; ``proj`` has (idx, proj) and the words' ``frequency``.
    """
    widths, nf = filters.branches, filters.n_filters
    slots = {(k, j): filters.slot(k, j, 0) for k in widths for j in range(k)}
    bias = np.concatenate([filters.b[k] for k in widths])

    def pool(n: int, doc: np.ndarray, pos: np.ndarray, p: np.ndarray) -> dict:
        best = []
        for k in widths:
            # the windows of n documents; a word adds to those that begin j places before it
            sums, reached = np.zeros((n, maxlen, nf)), np.zeros((n, maxlen), bool)
            for j in range(k):
                start = pos - j
                fits = (start >= 0) & (start <= maxlen - k)
                sums[doc[fits], start[fits]] += p[fits, slots[k, j]:slots[k, j] + nf]
                reached[doc[fits], start[fits]] = True
            top = np.where(reached[:, :, None], sums, -np.inf).max(axis=1)
            every = reached.sum(axis=1) == maxlen - k + 1
            best.append(np.where(every[:, None], top, np.maximum(top, 0.0)))
        return {"pooled": float_lists(np.maximum(np.concatenate(best, axis=1) + bias, 0.0))}
    return map_sequences(seqs, proj, id_col, seq_col, "proj", frequency, 8 * filters.n_slots + 64, pool, "pooled array<double>")


def pooled_cells(pooled: DataFrame, filters: ConvFilters, id_col: str) -> DataFrame:
    """(id, ``width``, ``filter``, ``value``) from the pooled arrays."""
    at = F.posexplode("pooled").alias("_at", "value")
    return pooled.select(id_col, at).select(
        id_col, F.element_at(F.array(*[F.lit(k) for k in filters.branches]), (F.col("_at") / filters.n_filters).cast("int") + 1).alias("width"),
        (F.col("_at") % filters.n_filters).cast("int").alias("filter"), "value")
