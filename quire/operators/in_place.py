"""Array rows of words (vectors, projections) brought to the documents' sequences.

A row per place would move a word's array once per occurrence. Here a document
stays one row: the arrays of the most frequent words, as many as fit into
``BUDGET`` bytes, go to the tasks once, and a task reads them off by index. Only
places of rarer words meet their arrays by a shuffle and are brought to their
document, a list of at most as many arrays as the sequence has words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_package

#: Bytes of arrays that go to every task.
BUDGET = 32 * 1024 * 1024
#: Documents handled at once, so that what is made of them stays small.
SLICE = 64

Made = Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def map_sequences(seqs: DataFrame, table: DataFrame, id_col: str, seq_col: str, array_col: str, frequency: str,
                  row_bytes: int, make: Made, out: str, budget: int | None = None) -> DataFrame:
    """(``id_col``, columns ``out``) of every row of ``seqs``.

    ``table`` is written and has (idx, ``array_col``, ``frequency``). ``make(n, doc,
    pos, rows)`` gets a few documents: for each place whose word is in the table its
    document (0 to n-1), its place there and the word's array, in text order; it
    gives an Arrow array of n values per column of ``out`` (name to SQL type).
    """
    spark = seqs.sparkSession
    ship_package(spark)
    most = max(1, (BUDGET if budget is None else budget) // row_bytes)
    whole = table.count() <= most  # written tables are counted from their footers
    hot = table if whole else table.orderBy(F.desc(frequency), "idx").limit(most)
    local = hot.select("idx", array_col).toArrow()
    keys = local.column("idx").to_numpy()
    order = np.argsort(keys, kind="stable")
    rows = _matrix(local.column(array_col), len(keys)) if len(keys) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((keys[order], np.ascontiguousarray(rows[order])))
    docs = seqs.select(F.col(id_col), F.col(seq_col).cast("array<bigint>").alias("_seq"))
    if not whole:
        frequent = F.broadcast(spark.createDataFrame(pa.table({"idx": keys})))
        places = docs.select(id_col, F.posexplode("_seq").alias("pos", "idx")).where("idx > 0").join(frequent, "idx", "left_anti")
        rare = table.select("idx", F.col(array_col).alias("row")).join(frequent, "idx", "left_anti")
        met = places.join(rare, "idx").groupBy(id_col).agg(F.collect_list(F.struct("pos", "row")).alias("_rare"))
        docs = docs.join(met, id_col, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, arrays = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                n, seq = b.num_rows, b.column("_seq")
                lengths = np.diff(seq.offsets.to_numpy())
                idx = seq.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(n), lengths)
                pos = np.arange(len(idx)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at = np.searchsorted(known, idx)
                found = np.zeros(len(idx), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == idx
                doc, pos, met_rows = doc[found], pos[found], arrays[at[found]]
                if "_rare" in b.schema.names:
                    more = b.column("_rare")
                    counts = np.where(more.is_valid().to_numpy(zero_copy_only=False), np.diff(more.offsets.to_numpy()), 0)
                    if counts.sum():
                        some = more.flatten()
                        rare_rows = _matrix(some.field("row"), len(some))
                        doc = np.concatenate([doc, np.repeat(np.arange(n), counts)])
                        pos = np.concatenate([pos, some.field("pos").to_numpy()])
                        met_rows = np.concatenate([met_rows, rare_rows]) if len(met_rows) else rare_rows
                        text = np.lexsort((pos, doc))
                        doc, pos, met_rows = doc[text], pos[text], met_rows[text]
                made = make(n, doc, pos, met_rows)
                yield pa.RecordBatch.from_arrays([b.column(id_col), *made.values()], [id_col, *made])
    return docs.mapInArrow(run, f"{id_col} {seqs.schema[id_col].dataType.simpleString()}, {out}")


def float_lists(values: np.ndarray) -> pa.ListArray:
    """A list per row of a matrix."""
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
