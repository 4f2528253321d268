"""Bag-of-words features in long form.

A feature matrix is a DataFrame ``(id, idx, term, value)`` with one row per
non-zero cell. Every step is a join or an aggregation that Spark partitions:

* documents are hash-partitioned by id once; their terms are counted there, a
  few documents at a time (``by_document``), without a row per occurrence;
* vocabulary + document frequency: ``groupBy(term)`` with map-side partial
  counts, so a term in every document costs one partial row per task;
* idf lookup: an equi-join on ``term``; the most frequent terms by the fitted
  ``df``, as many as fit a byte budget, are broadcast, rarer ones shuffled;
* row norms: a window partitioned by the document id, over partitions whose
  number grows with the table.

The vocabulary is indexed alphabetically (binary string order), the idf is
``ln((1+n)/(1+df)) + 1`` (smooth) or ``ln(n/df) + 1``, the tf is a count or
``1 + ln(tf)``, the norm is l2, l1 or none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.analyzers import ENGLISH_STOP_WORDS, analyzer
from quire.operators.by_document import count_words
from quire.operators.hot_join import hot_join
from quire.operators.rows import deal_by, with_row_index
from quire.session import stored

#: What a term, its index, frequency and idf take in a broadcast.
VOCABULARY_ROW_BYTES = 128


@dataclass(frozen=True)
class VectorizerParams:
    ngram_range: tuple = (1, 1)
    norm: str | None = "l2"
    smooth_idf: bool = True
    sublinear_tf: bool = False
    stop_words: tuple | None = None
    lowercase: bool = True
    use_idf: bool = True

    def with_stop_words(self, on: bool) -> "VectorizerParams":
        return _replace(self, stop_words=tuple(ENGLISH_STOP_WORDS) if on else None)


def _replace(p: VectorizerParams, **kw) -> VectorizerParams:
    d = dict(p.__dict__)
    d.update(kw)
    return VectorizerParams(**d)


TFIDF = VectorizerParams()
COUNT = VectorizerParams(norm=None, use_idf=False)


@dataclass
class FittedVocabulary:
    """Fitted state of a vectorizer: the vocabulary table and its size."""
    table: DataFrame          # term, idx, df, idf
    size: int
    n_docs: int
    params: VectorizerParams = field(default_factory=VectorizerParams)


def term_frequencies(df: DataFrame, id_col: str, text_col: str, params: VectorizerParams = TFIDF, keep=(),
                     grouped: bool = False) -> DataFrame:
    """(id, ``keep``, term, tf): raw counts per document; ``keep`` are columns of
    the documents. ``grouped`` leaves a document's terms and counts as two lists
    in one row.

    Documents are dealt out by id once, so rows of one id are counted together;
    their terms are counted where they then lie.
    """
    terms = analyzer(text_col, params.ngram_range, params.stop_words, params.lowercase)
    keys = list(dict.fromkeys([id_col, *keep]))
    dealt = deal_by(df.select(*keys, F.col(text_col).alias("_text")), id_col, like=df).sortWithinPartitions(*keys)
    return count_words(dealt.withColumnRenamed("_text", text_col).select(*keys, terms.alias("_words")), keys, grouped)


def counted_terms(df: DataFrame, id_col: str, text_col: str, params: VectorizerParams = TFIDF,
                  split_col: str = "split") -> DataFrame:
    """:func:`term_frequencies` with the split, written: texts are analysed once,
    a vocabulary is fitted on the train part of what is counted, and all of it is
    transformed."""
    return stored(term_frequencies(df, id_col, text_col, params, (split_col,)), "term-counts")


def fit_vocabulary(tf_train: DataFrame, n_docs: int, params: VectorizerParams = TFIDF,
                   id_col: str | None = None) -> FittedVocabulary:
    """F4 + F6/F7: distinct training terms, alphabetical index, df and idf."""
    dfreq = tf_train.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocab = with_row_index(dfreq, ["term"], name="idx", columnar=True)
    # The numbered terms are written as Parquet, so their size in bytes decides how
    # they are joined; numbers and idf are made of them as they are read.
    vocab = vocab.select("term", "idx", "df", idf_of(F.col("df"), n_docs, params).alias("idf"))
    size = vocab.count()
    return FittedVocabulary(vocab, size, n_docs, params)


def tf_weight(params: VectorizerParams):
    tf = F.col("tf").cast("double")
    return (F.log(tf) + 1.0) if params.sublinear_tf else tf


def normalize(df: DataFrame, id_col: str, value_col: str, norm: str | None) -> DataFrame:
    """divide each row's values by its l2 / l1 norm (no-op for None)."""
    if norm is None:
        return df
    w = Window.partitionBy(id_col)
    v = F.col(value_col)
    if norm == "l2":
        denom = F.sqrt(F.sum(v * v).over(w))
    elif norm == "l1":
        denom = F.sum(F.abs(v)).over(w)
    else:
        raise ValueError(f"unknown norm {norm!r}")
    return df.withColumn(value_col, F.when(denom > 0, v / denom).otherwise(v))


def transform(tf: DataFrame, vocab: FittedVocabulary, id_col: str) -> DataFrame:
    """weights of the known terms, normalised per document."""
    p = vocab.params
    # The most frequent terms are met by a broadcast of bounded size; only rarer
    # ones are shuffled. Unknown terms drop out (inner).
    joined = hot_join(tf, vocab.table, "term", "df", VOCABULARY_ROW_BYTES, id_col)
    value = tf_weight(p) * (F.col("idf") if p.use_idf else F.lit(1.0))
    out = joined.select(F.col(id_col), "idx", "term", value.alias("value"))
    if p.norm is not None:  # the window sorts what a task holds
        out = deal_by(out, id_col, like=tf)
    return normalize(out, id_col, "value", p.norm)


def idf_of(df, n_docs: int, params: VectorizerParams):
    """F6, F7 for the document frequency ``df``."""
    n = F.lit(float(n_docs))
    return (F.log((n + 1.0) / (df + 1.0)) if params.smooth_idf else F.log(n / df)) + 1.0


def block_features(df: DataFrame, id_col: str, texts: list[tuple[str, VectorizerParams]], fit, n_fit: int) -> tuple[DataFrame, int]:
    """a vocabulary per text column, blocks side by side, in one pass.

    All columns are counted together; numbering the terms by (block, term) gives
    every block its own index range at once. ``fit`` is the column of ``df`` that
    marks the ``n_fit`` rows to fit on. Returns (id, idx, value) and the width.
    """
    arrays = F.array(*[analyzer(c, p.ngram_range, p.stop_words, p.lowercase) for c, p in texts])
    terms = deal_by(df.select(id_col, fit.alias("_fit"), *[c for c, _ in texts]), id_col, like=df) \
        .select(id_col, "_fit", F.posexplode(arrays).alias("block", "_terms"))
    tf = stored(terms.select(id_col, "_fit", "block", F.explode("_terms").alias("term"))
                .groupBy(id_col, "_fit", "block", "term").agg(F.count(F.lit(1)).alias("tf")), "block-counts")
    dfreq = tf.where("_fit").groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"))

    def per_block(make):
        return F.element_at(F.array(*[make(p) for _, p in texts]), F.col("block") + 1)
    vocab = with_row_index(dfreq, ["block", "term"], name="idx", columnar=True)
    vocab = stored(vocab.select("block", "term", "idx", "df", per_block(
        lambda p: idf_of(F.col("df"), n_fit, p) if p.use_idf else F.lit(1.0)).alias("idf")), "vocabulary")
    met = hot_join(tf.drop("_fit"), vocab, ["block", "term"], "df", VOCABULARY_ROW_BYTES, id_col)
    out = deal_by(met.select(id_col, "block", "idx", (per_block(tf_weight) * F.col("idf")).alias("value")), id_col, like=tf)
    w, v = Window.partitionBy(id_col, "block"), F.col("value")
    size = per_block(lambda p: {"l2": F.sqrt(F.sum(v * v).over(w)), "l1": F.sum(F.abs(v)).over(w), None: F.lit(1.0)}[p.norm])
    return out.withColumn("value", F.when(size > 0, v / size).otherwise(v)).select(id_col, "idx", "value"), vocab.count()


def keep_empty_rows(features: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Documents without any known term keep one row with null idx/value."""
    return rows.select(id_col).join(features, id_col, "left")


def offset(features: DataFrame, by: int) -> DataFrame:
    """Shift a block's indices (F13 / F23 side-by-side blocks)."""
    return features.withColumn("idx", F.col("idx") + F.lit(by))


def numeric_block(df: DataFrame, id_col: str, cols, start: int) -> DataFrame:
    """numeric columns passed through unscaled as a long-form block."""
    parts = [df.select(F.col(id_col), F.lit(start + i).cast("bigint").alias("idx"),
                       F.lit(c).alias("term"), F.col(c).cast("double").alias("value"))
             for i, c in enumerate(cols)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value") != 0.0)
