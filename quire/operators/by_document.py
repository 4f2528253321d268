"""Words handled where their document lies, as numbers in Arrow batches.

A row per word is costly before anything is counted: every occurrence would be a
row with its text, hashed twice by an aggregate. Here a document's words stay a
list in its row. A few documents at a time their words become codes, and what is
made of them (counts, first places, indices) is made on codes by numpy. Spark
deals the documents out and brings together what concerns several of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_package

#: Words handled at once, or one document's.
PIECE = 1 << 18


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows in pieces of about ``PIECE`` list values: the rows, the lengths of their
    lists in ``column`` (null: 0), the lists' values one after the other."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // PIECE
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
            rows = batch.slice(lo, hi - lo)
            yield rows, lengths[lo:hi], rows.column(column).flatten()


def _text(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of texts and the distinct texts."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _new(keys: pa.RecordBatch) -> np.ndarray:
    """Does a row's key differ from that of the row before it?"""
    new = np.zeros(keys.num_rows, bool)
    new[:1] = True
    for c in keys.columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        same = pc.or_(pc.equal(a, b).fill_null(False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _type(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _counted(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """(keys of the documents, document, word and count of each cell), whole
    documents at a time; rows of one document follow each other. Counts of the
    last one are held back, as its next row may be in the next piece."""
    held = None
    for rows, lengths, words in pieces(batches, "_words"):
        own = rows.select(keys)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        n = np.ones(len(doc), np.int64)
        if held is not None:
            own = pa.concat_batches([held[0], own])
            doc, n, words = np.concatenate([np.zeros(len(held[2]), np.int64), doc + 1]), np.concatenate([held[2], n]), pa.concat_arrays([held[1], words])
        new = _new(own)
        doc, own = (np.cumsum(new) - 1)[doc], own.filter(pa.array(new))
        codes, texts = _text(words)
        cell = doc * max(len(texts), 1) + codes
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        cells = cell[order][starts]
        n = np.add.reduceat(n[order], starts) if len(starts) else n
        doc, words = cells // max(len(texts), 1), texts.take(pa.array(cells % max(len(texts), 1)))
        last = own.num_rows - 1
        cut = int(np.searchsorted(doc, last))
        held = own.slice(last), words.slice(cut), n[cut:]
        yield own.slice(0, last), doc[:cut], words.slice(0, cut), n[:cut]
    if held is not None:
        yield held[0], np.zeros(len(held[2]), np.int64), held[1], held[2]


def count_words(docs: DataFrame, keys: list[str], grouped: bool = False) -> DataFrame:
    """(``keys``, ``term``, ``tf``) of the lists ``_words`` of ``docs``, or with ``grouped``
    a row per document with these two as lists. Rows of one key lie in one
    partition, one after the other."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, doc, words, n in _counted(batches, keys):
            if grouped:
                ends = pa.array(np.searchsorted(doc, np.arange(own.num_rows + 1)), pa.int32())
                made = [*own.columns, pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(n))]
            else:
                made = [*own.take(pa.array(doc)).columns, words, pa.array(n)]
            yield pa.RecordBatch.from_arrays(made, [*keys, "term", "tf"])
    kind = "term array<string>, tf array<bigint>" if grouped else "term string, tf bigint"
    return docs.mapInArrow(run, ", ".join([*(_type(docs, k) for k in keys), kind]))


def first_and_count(docs: DataFrame, order_col: str) -> DataFrame:
    """(term, n, o, p) of the lists ``_words``: words counted over a few documents, with
    their least ``order_col`` and the first place there; terms come several times."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, words in pieces(batches, "_words"):
            rank = np.empty(len(lengths), np.int64)
            rank[pc.sort_indices(rows.column(order_col)).to_numpy()] = np.arange(len(lengths))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            codes, texts = _text(words)
            # from the last occurrence to the first, so the first one stays
            back = np.argsort(rank[doc], kind="stable")[::-1]
            first = np.empty(len(texts), np.int64)
            first[codes[back]] = back
            made = [texts, pa.array(np.bincount(codes, minlength=len(texts))), rows.column(order_col).take(pa.array(doc[first])),
                    pa.array(place[first])]
            yield pa.RecordBatch.from_arrays(made, ["term", "n", "o", "p"])
    kind = docs.schema[order_col].dataType.simpleString()
    return docs.mapInArrow(run, f"term string, n bigint, o {kind}, p bigint")


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def look_up(docs: DataFrame, table: DataFrame, keys: list[str], rare: bool = False) -> DataFrame:
    """(``keys``, ``seq``): the ``idx`` of each word of the lists ``_words``, 0 if ``table`` (term,
    idx; small, every task gets it) has none; with ``rare`` also the places and terms
    of these words."""
    spark = docs.sparkSession
    ship_package(spark)
    local = table.select("term", F.col("idx").cast("int").alias("idx")).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast([(c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in local.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = shared.value
        numbers = np.concatenate([[0], numbers.to_numpy()]).astype(np.int32)
        for rows, lengths, words in pieces(batches, "_words"):
            coded = words.dictionary_encode()
            own = numbers[pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False) + 1]
            idx = own[coded.indices.to_numpy(zero_copy_only=False)]
            made = [*rows.select(keys).columns, _lists(lengths, pa.array(idx))]
            if rare:
                at = np.flatnonzero(idx == 0)
                starts = np.cumsum(lengths) - lengths
                # of several lists that start together only the last has values
                doc = np.searchsorted(starts, at, side="right") - 1
                places = pa.StructArray.from_arrays([pa.array((at - starts[doc]).astype(np.int32)), words.take(pa.array(at))], ["pos", "term"])
                made.append(_lists(np.bincount(doc, minlength=len(lengths)), places))
            yield pa.RecordBatch.from_arrays(made, [*keys, "seq", *(["rare"] if rare else [])])
    more = ", rare array<struct<pos: int, term: string>>" if rare else ""
    return docs.mapInArrow(run, ", ".join(_type(docs, k) for k in keys) + ", seq array<int>" + more)


def fill_in(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, seq) of (id, ``seq``, ``_rare``): indices are put in their places, places
    still 0 are dropped. ``_rare`` has a place in the upper and an index in the lower 32 bits."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, idx in pieces(batches, "seq"):
            idx = idx.to_numpy(zero_copy_only=False).copy()
            found = rows.column("_rare")
            n = pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)
            both = found.flatten().to_numpy(zero_copy_only=False)
            idx[np.repeat(np.cumsum(lengths) - lengths, n) + (both >> 32)] = both & 0xFFFFFFFF
            doc = np.repeat(np.arange(len(lengths)), lengths)[idx > 0]
            seq = _lists(np.bincount(doc, minlength=len(lengths)), pa.array(idx[idx > 0]))
            yield pa.RecordBatch.from_arrays([rows.column(id_col), seq], [id_col, "seq"])
    return docs.select(id_col, "seq", "_rare").mapInArrow(run, f"{_type(docs, id_col)}, seq array<int>")
