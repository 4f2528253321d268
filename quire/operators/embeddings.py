"""Word-vector lookup.

The weight matrix of the reference is a left outer equi-join here: word
index ⟕ word vectors on the word, missing vectors become zeros, index 0
(padding) is zeros. Which side is broadcast is left to AQE's measured
sizes; both sides can be large (vocabulary of a corpus, a vector file of
millions of words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.in_place import float_lists, map_sequences
from quire.session import stored


def zeros(dim: int) -> F.Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def vectors_from_table(embeddings: DataFrame, word_index: DataFrame) -> DataFrame:
    """(word, vec) from the driver's ``embeddings`` table: word index i takes
    the vector whose ``vec_id`` is i."""
    return (word_index.select("term", "idx")
            .join(embeddings.select("vec_id", "embedding"),
                  F.col("idx") == F.col("vec_id"))
            .select(F.col("term").alias("word"), F.col("embedding").alias("vec")))


def embedding_matrix(word_index: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(idx, term, cnt, known, vec) for every indexed word."""
    v = vectors.select(F.col("word").alias("term"), F.col("vec").alias("_v"))
    cnt = F.col("cnt") if "cnt" in word_index.columns else F.lit(1).cast("long")
    return (word_index.select("term", "idx", cnt.alias("cnt")).join(v, "term", "left")
            .select("idx", "term", "cnt", F.col("_v").isNotNull().alias("known"),
                    F.coalesce(F.col("_v"), zeros(dim)).alias("vec")))


def coverage(word_index: DataFrame, vectors: DataFrame) -> DataFrame:
    """number of loaded vectors and how much of the vocabulary they cover."""
    n_vectors = vectors.count()
    v = vectors.select(F.col("word").alias("term"), F.lit(True).alias("_k"))
    return (word_index.select("term").join(v, "term", "left")
            .agg(F.count(F.lit(1)).alias("vocab_size"),
                 F.count("_k").alias("covered"))
            .select(F.lit(n_vectors).cast("bigint").alias("n_vectors"), "vocab_size", "covered",
                    F.round(F.col("covered") / F.col("vocab_size"), 4).alias("coverage")))


def _map_vectors(seqs: DataFrame, matrix: DataFrame, id_col: str, dim: int, seq_col: str, make, out: str) -> DataFrame:
    """Padding and unknown words, which are zeros, are left out."""
    known = stored(matrix.where("known").select("idx", "vec", "cnt"), "word-vectors")
    return map_sequences(seqs, known, id_col, seq_col, "vec", "cnt", 4 * dim + 64, make, out)


def embed_positions(seqs: DataFrame, matrix: DataFrame, id_col: str, dim: int, seq_col: str = "seq") -> DataFrame:
    """(id, ``pos``, ``vecs``), a row per document: the positions whose word has a
    vector, in text order, and these vectors one after the other."""
    def make(n, doc, pos, vecs):
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))
        flat = pa.array(vecs.reshape(-1).astype(np.float32))
        return {"pos": places, "vecs": pa.ListArray.from_arrays(pa.array(ends * dim, pa.int32()), flat)}
    return _map_vectors(seqs, matrix, id_col, dim, seq_col, make, "pos array<int>, vecs array<float>")


def embed_flatten(seqs: DataFrame, matrix: DataFrame, id_col: str, dim: int, maxlen: int = 400,
                  seq_col: str = "seq", of_rows: dict | None = None) -> DataFrame:
    """(id, flat array<float>) = the padded row of ``maxlen`` words embedded
    and flattened, zeros where no vector is. ``of_rows`` adds a double column a name: its
    function gets a few flattened rows as a matrix, where they are made (as SQL lambdas
    each of their ``maxlen * dim`` numbers costs more than all that comes before)."""
    more = of_rows or {}

    def make(n, doc, pos, vecs):
        flat = np.zeros((n, maxlen, dim), np.float32)
        if len(doc):
            flat[doc, pos] = vecs
        flat = flat.reshape(n, -1)
        return {"flat": float_lists(flat), **{name: pa.array(of(flat), pa.float64()) for name, of in more.items()}}
    return _map_vectors(seqs, matrix, id_col, dim, seq_col, make, ", ".join(["flat array<float>", *(f"`{name}` double" for name in more)]))
