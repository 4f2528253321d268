"""Registered queries for index sequences, word vectors and the n-gram
convolution (S3, S4, F14-F22)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.operators import conv as CV
from quire.operators import embeddings as EM
from quire.operators import scoring as SC
from quire.operators import sequences as SQ
from quire.session import stored
from quire.sources.papers import load_table
from quire.sources.vectors import parse_vector_lines, vector_lines_from_table, word_lines_from_table
from quire.plans.common import one_text, round4

MAXLEN = 400
DIM = 64


def _base(spark, sf):
    docs = one_text(spark, sf)
    wi = SQ.fit_word_index(docs, "paper_id", "text", order_col="paper_id")
    return docs, wi


def _digest(arr):
    return F.md5(F.array_join(F.transform(arr, lambda x: x.cast("string")), " "))


def _vsum(arr):
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def _vsq(arr):
    return F.aggregate(arr, F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def q_sequence_vocabulary(spark, sf):
    _, wi = _base(spark, sf)
    return wi.select("term", "idx", "cnt")


def q_texts_to_sequences(spark, sf):
    docs, wi = _base(spark, sf)
    seqs = SQ.texts_to_sequences(docs, wi, "paper_id", "text")
    return seqs.select("paper_id", F.size("seq").cast("bigint").alias("n"), _digest(F.col("seq")).alias("digest"))


def q_pad_sequences(spark, sf):
    docs, wi = _base(spark, sf)
    seqs = SQ.texts_to_sequences(docs, wi, "paper_id", "text")
    padded = SQ.pad_sequences("seq", MAXLEN)
    return seqs.select("paper_id", F.size(padded).cast("bigint").alias("n"),
                       F.size(F.filter(padded, lambda x: x != 0)).cast("bigint").alias("n_words"),
                       _digest(padded).alias("digest"))


def _vectors(spark, sf, wi):
    return EM.vectors_from_table(load_table(spark, sf, "embeddings"), wi)


def q_embedding_lookup(spark, sf):
    _, wi = _base(spark, sf)
    m = EM.embedding_matrix(wi, _vectors(spark, sf, wi), 64)
    return m.select("idx", "term", "known", round4(_vsum(F.col("vec"))).alias("vsum"),
                    round4(F.sqrt(_vsq(F.col("vec")))).alias("vnorm"))


def q_embedding_coverage(spark, sf):
    _, wi = _base(spark, sf)
    return EM.coverage(wi, _vectors(spark, sf, wi))


def _parse(spark, sf, fmt):
    """The lines of all indexed words with a vector, each followed by a
    good or bad line by rule."""
    _, wi = _base(spark, sf)
    table = load_table(spark, sf, "embeddings")
    lines = word_lines_from_table(table, wi).withColumn("line_no", 2 * F.col("line_no")).unionByName(
        vector_lines_from_table(table).withColumn("line_no", 2 * F.col("line_no") + 1))
    vecs, _ = parse_vector_lines(lines, fmt=fmt, dim=DIM)
    return vecs.select("word", F.size("vec").cast("bigint").alias("dim"), round4(_vsum(F.col("vec"))).alias("vsum"))


def _rejected(spark, sf, fmt):
    _, rejects = parse_vector_lines(vector_lines_from_table(load_table(spark, sf, "embeddings")), fmt=fmt, dim=DIM)
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(fmt).alias("format"), "reason", "n")


def q_embedding_rejects(spark, sf):
    return _rejected(spark, sf, "glove").unionByName(_rejected(spark, sf, "w2v"))


def q_embedding_parse(spark, sf):
    return _parse(spark, sf, "glove")


def q_embedding_parse_w2v(spark, sf):
    return _parse(spark, sf, "w2v")


def _sums(rows: np.ndarray) -> np.ndarray:
    """Of each row, added up from left to right like a fold in SQL."""
    return np.add.accumulate(rows, axis=1, dtype=np.float64)[:, -1]


def _position_sums(rows: np.ndarray) -> np.ndarray:
    """Weighted by position, so the flattening order is part of the check."""
    return _sums(rows * (np.arange(rows.shape[1]) % 5 + 1.0))


def q_embed_flatten(spark, sf):
    docs, wi = _base(spark, sf)
    seqs = SQ.texts_to_sequences(docs, wi, "paper_id", "text")
    kept = seqs.select("paper_id", SQ.truncate_sequences("seq", MAXLEN).alias("seq"))
    m = EM.embedding_matrix(wi, _vectors(spark, sf, wi), 64)
    flat = EM.embed_flatten(stored(kept, "sequences"), m, "paper_id", 64, MAXLEN,
                            of_rows={"fsum": _sums, "wsum": _position_sums})
    return flat.select("paper_id", F.size("flat").alias("n_values"), round4("fsum").alias("fsum"), round4("wsum").alias("wsum"))


def kept_sequences(spark, sf):
    """The papers' last words as indices, and the word vectors."""
    docs, wi = _base(spark, sf)
    seqs = SQ.texts_to_sequences(docs, wi, "paper_id", "text")
    kept = stored(seqs.select("paper_id", SQ.truncate_sequences("seq", MAXLEN).alias("seq")), "sequences")
    return kept, EM.embedding_matrix(wi, _vectors(spark, sf, wi), DIM)


def q_ngram_conv_pool(spark, sf):
    kept, m = kept_sequences(spark, sf)
    filters = CV.rule_filters(DIM)
    pooled = CV.conv_pool(kept, CV.slot_projections(m, filters), filters, "paper_id", MAXLEN)
    return CV.pooled_cells(pooled, filters, "paper_id").select("paper_id", "width", "filter", round4("value").alias("value"))


def _output(h):
    return round4(SC.output_unit("h", SC.rule_array(SC.HIDDEN, SC.OUTPUT), SC.OUTPUT_BIAS)).alias("prediction")


def q_ncnn_score(spark, sf):
    """M8 + M12 with given weights: pooled windows, 100 units, one output."""
    kept, m = kept_sequences(spark, sf)
    filters = CV.rule_filters(DIM)
    pooled = CV.conv_pool(kept, CV.slot_projections(m, filters), filters, "paper_id", MAXLEN)
    cells = pooled.select("paper_id", F.posexplode("pooled").alias("idx", "value"))
    # 60 rows of weights; every paper has every cell
    n = filters.n_filters * len(filters.branches)
    weights = spark.range(n).select(F.col("id").cast("int").alias("idx"), F.lit(1).alias("df")).withColumn(
        "w", SC.rule_array(SC.HIDDEN, "(((3 * idx + 7 * u) % 13) - 6) / 50.0D"))
    h = SC.sparse_layer(cells, weights, kept, "paper_id", SC.rule_array(SC.HIDDEN, SC.HIDDEN_BIAS), SC.HIDDEN)
    return h.select("paper_id", _output("h"))


def q_dense_score(spark, sf):
    """M7 + M12 with given weights: 400 flattened word vectors, 100 units, one output."""
    kept, m = kept_sequences(spark, sf)
    positions = EM.embed_positions(kept, m, "paper_id", DIM)

    def weights_at(pos):
        d, u = np.arange(DIM)[:, None] + pos * DIM, np.arange(SC.HIDDEN)[None, :]
        return ((3 * d + 7 * u) % 13 - 6) / 500.0
    h = SC.position_layer(positions, kept, "paper_id", weights_at, SC.rule_array(SC.HIDDEN, SC.HIDDEN_BIAS), SC.HIDDEN)
    return h.select("paper_id", _output("h"))


QUERIES = {
    "sequence_vocabulary": q_sequence_vocabulary,
    "texts_to_sequences": q_texts_to_sequences,
    "pad_sequences": q_pad_sequences,
    "embedding_parse": q_embedding_parse,
    "embedding_parse_w2v": q_embedding_parse_w2v,
    "embedding_rejects": q_embedding_rejects,
    "embedding_lookup": q_embedding_lookup,
    "embedding_coverage": q_embedding_coverage,
    "embed_flatten": q_embed_flatten,
    "ngram_conv_pool": q_ngram_conv_pool,
    "ncnn_score": q_ncnn_score,
    "dense_score": q_dense_score,
}
