"""signed feature hashing, no fit.

Each term goes to bucket ``|h| mod width`` with sign ``+1`` if ``h >= 0``
else ``-1``, where ``h`` is the signed 32-bit value of the first four bytes
of the term's MD5 digest (portable across engines; the bucket identity is
ours, the width, sign rule and norm are the workload's). Counts with signs
are summed per (document, bucket), then rows are l2-normalised.

The hash is computed once per distinct term of a few documents, and a document's
buckets are summed and normed where its terms lie, without a row per term before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.by_document import pieces
from quire.operators.rows import deal_by
from quire.session import ship_package

DEFAULT_WIDTH = 1 << 20
NORMS = ("l2", "l1", None)


def signed_hash(term) -> F.Column:
    t = F.col(term) if isinstance(term, str) else term
    u = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    return F.when(u >= F.lit(1 << 31), u - F.lit(1 << 32)).otherwise(u)


def signed_hashes(terms: pa.Array) -> np.ndarray:
    """:func:`signed_hash` of each text."""
    heads = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:4] for t in terms.to_pylist())
    return np.frombuffer(heads, ">i4").astype(np.int64)


def hash_features(tf: DataFrame, id_col: str, width: int = DEFAULT_WIDTH,
                  norm: str | None = "l2") -> DataFrame:
    """(id, idx, value) from (id, term, tf), one row a term or, with the two as
    lists, one row a document."""
    if norm not in NORMS:
        raise ValueError(f"unknown norm {norm!r}")
    if not isinstance(tf.schema["term"].dataType, T.ArrayType):
        tf = (deal_by(tf.select(id_col, "term", "tf"), id_col).groupBy(id_col)
              .agg(F.collect_list("term").alias("term"), F.collect_list("tf").alias("tf")))
    ship_package(tf.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, terms in pieces(batches, "term"):
            coded = terms.dictionary_encode()
            h = signed_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            v = np.where(h >= 0, 1.0, -1.0) * rows.column("tf").flatten().to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(lengths)), lengths) * width + np.abs(h) % width
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            value = np.add.reduceat(v[order], starts) if len(starts) else v
            cell, value = cell[order][starts][value != 0.0], value[value != 0.0]
            doc = cell // width
            if norm is not None:
                sizes = np.bincount(doc, value * value if norm == "l2" else np.abs(value), len(lengths))[doc]
                value = value / (np.sqrt(sizes) if norm == "l2" else sizes)
            yield pa.RecordBatch.from_arrays([rows.column(id_col).take(pa.array(doc)), pa.array(cell % width), pa.array(value)],
                                             [id_col, "idx", "value"])
    return tf.select(id_col, "term", "tf").mapInArrow(
        run, f"`{id_col}` {tf.schema[id_col].dataType.simpleString()}, idx bigint, value double")
