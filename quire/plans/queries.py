"""Registered queries: one per operator of the inventory, each reading the
driver's tables at ``sf_dir`` and returning a DataFrame.

Column names match the DuckDB oracle in :mod:`quire.plans.oracle_queries`;
floating-point results are rounded to 4 digits in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import analyzers as AZ
from quire.functions import text as TX
from quire.operators import tfidf as TF
from quire.operators.hashing import DEFAULT_WIDTH, hash_features
from quire.operators.splits import contiguous_folds, positional_split
from quire.plans.common import one_text, papers, round4, tokenized
from quire.session import scratch_path
from quire.sources.papers import load_table, paper_numbers, read_papers_with_rejects, whole_number

# ---------------------------------------------------------------------------
# sources, rows, splits
# ---------------------------------------------------------------------------


def q_row_ids(spark, sf):
    return papers(spark, sf, rn=True).select("paper_id", "rn")


def q_union_splits(spark, sf):
    p = papers(spark, sf, rn=True, split=True)
    train = p.where("split = 'train'").select("split", "paper_id", "rn")
    test = p.where("split = 'test'").select("split", "paper_id", "rn")
    return train.unionByName(test)


def q_split_counts(spark, sf):
    return papers(spark, sf, split=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def q_typed_casts(spark, sf):
    """T12, T13 over every document: its length as one of ten JSON values."""
    n = F.col("n_chars").cast("string")
    text = (F.when(F.col("doc_id") % 10 == 0, n)
            .when(F.col("doc_id") % 10 == 1, F.concat(F.lit('"'), n, F.lit('"')))
            .when(F.col("doc_id") % 10 == 2, F.concat(n, F.lit(".9")))
            .when(F.col("doc_id") % 10 == 3, F.concat(F.lit('"'), n, F.lit('.9"')))
            .when(F.col("doc_id") % 10 == 4, F.concat(F.lit('" -'), n, F.lit('\\t"')))
            .when(F.col("doc_id") % 10 == 5, F.concat(F.lit('"'), n, F.lit('e1"')))
            .when(F.col("doc_id") % 10 == 6, F.lit("true"))
            .when(F.col("doc_id") % 10 == 7, F.concat(F.lit('"'), n, F.lit('_5"')))
            .when(F.col("doc_id") % 10 == 8, F.concat(F.lit("-"), n, F.lit(".5")))
            .otherwise(F.concat(n, F.lit("e2"))))
    docs = load_table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.parse_json(text).alias("v"))
    value = whole_number("v")
    return docs.select("paper_id", value.alias("value"), value.isNull().alias("wrong"))


def q_paper_rejects(spark, sf):
    """S1 over every document, written as JSON lines, some broken or incomplete:
    how many are rejected why, and how much raw text is kept of them."""
    d = load_table(spark, sf, "documents")
    kind = F.col("doc_id") % 7
    whole = F.to_json(F.struct(
        F.when(kind != 3, F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))).alias("title"),
        F.coalesce("text", F.lit("")).alias("abstract"), F.array("source").alias("keywords"), F.coalesce("source", F.lit("")).alias("venue"),
        F.when(kind != 4, 1990).alias("year"), F.lit("3").alias("n_citation"), F.when(kind != 2, F.col("n_chars")).alias("plength")))
    line = F.when(kind == 1, F.concat(F.lit('{"title": '), F.col("doc_id").cast("string"), F.lit("!"))).otherwise(whole)
    path = scratch_path(spark, "papers-json")
    d.select(line.alias("value")).write.text(path)
    good, bad = read_papers_with_rejects(spark, path)
    both = good.select(F.lit("good").alias("reason"), F.lit(0).alias("size")) \
        .unionByName(bad.select("reason", F.coalesce(F.length("line"), F.lit(0)).alias("size")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("raw_chars"))


def q_positional_split(spark, sf):
    """D3 with 80 % of the papers for training and the next 10 % for testing."""
    numbers, n_train = paper_numbers(spark, sf)
    split = positional_split(numbers, "rn", n_train, n_train // 8)
    return split.select("paper_id", "rn", "part")


def q_contiguous_folds(spark, sf):
    train = papers(spark, sf, rn=True, split=True).where("split = 'train'")
    n_train = train.count()
    return contiguous_folds(train, "rn", n_train, 4).select("paper_id", "rn", "fold")


# ---------------------------------------------------------------------------
# scalar text functions
# ---------------------------------------------------------------------------


def q_lower_ascii(spark, sf):
    return papers(spark, sf).select("paper_id", TX.lower_ascii("title").alias("value"))


def q_keyword_summary(spark, sf):
    return papers(spark, sf).select("paper_id", TX.keyword_summary("keywords").alias("value"))


def q_symbol_split(spark, sf):
    return papers(spark, sf).select("paper_id", TX.symbol_split("abstract").alias("value"))


def q_treebank_tokens(spark, sf):
    toks = TX.treebank_tokens("abstract")
    return papers(spark, sf).select("paper_id", F.size(toks).cast("bigint").alias("n_tokens"),
                                    F.array_join(toks, " ").alias("value"))


def q_period_split(spark, sf):
    toks = TX.split_periods(TX.treebank_tokens("abstract"))
    return papers(spark, sf).select("paper_id", F.array_join(toks, " ").alias("value"))


def q_core_tokenize(spark, sf):
    return papers(spark, sf).select("paper_id", TX.core_tokenize("abstract").alias("value"))


def q_record_tokenize(spark, sf):
    return tokenized(spark, sf, split=False).select("paper_id", F.col("kw").alias("keywords"),
                                       F.col("title_t").alias("title"),
                                       F.col("abstract_t").alias("abstract"))


def q_concat_text(spark, sf):
    return one_text(spark, sf, split=False).select("paper_id", "text")


def q_typed_features(spark, sf):
    t = tokenized(spark, sf, split=False)
    return t.select("paper_id", F.col("kw").alias("keywords"), F.col("title_t").alias("title"),
                    F.col("abstract_t").alias("abstract"), "venue", "year",
                    F.col("n_citation").alias("citations"), "label")


# ---------------------------------------------------------------------------
# analyzers
# ---------------------------------------------------------------------------


def q_analyze_terms(spark, sf):
    terms = AZ.analyze("text")
    return one_text(spark, sf, split=False).select("paper_id", F.size(terms).cast("bigint").alias("n_terms"),
                                      F.md5(F.array_join(terms, "|")).alias("digest"))


def q_ngram_terms(spark, sf):
    grams = AZ.analyzer("text", (1, 3))
    return one_text(spark, sf, split=False).select("paper_id", F.size(grams).cast("bigint").alias("n_terms"),
                                      F.md5(F.array_join(grams, "|")).alias("digest"))


def q_stopword_filter(spark, sf):
    kept = AZ.remove_stop_words(AZ.analyze("text"), AZ.ENGLISH_STOP_WORDS)
    return one_text(spark, sf, split=False).select("paper_id", F.size(kept).cast("bigint").alias("n_terms"),
                                      F.md5(F.array_join(kept, "|")).alias("digest"))


# ---------------------------------------------------------------------------
# bag-of-words features
# ---------------------------------------------------------------------------


def _fit_train(spark, sf, params=TF.TFIDF, text="text"):
    """Papers, their counted terms, and the vocabulary of the train papers."""
    docs = one_text(spark, sf)
    tf = TF.counted_terms(docs, "paper_id", text, params)
    vocab = TF.fit_vocabulary(tf.where("split = 'train'"), docs.where("split = 'train'").count(), params)
    return docs, tf, vocab


def q_vocabulary(spark, sf):
    _, _, vocab = _fit_train(spark, sf)
    return vocab.table.select("term", "idx", "df", round4("idf").alias("idf"))


def q_idf_smooth(spark, sf):
    _, _, vocab = _fit_train(spark, sf, TF.TFIDF)
    return vocab.table.select("term", round4("idf").alias("idf"))


def q_idf_raw(spark, sf):
    _, _, vocab = _fit_train(spark, sf, TF.VectorizerParams(smooth_idf=False))
    return vocab.table.select("term", round4("idf").alias("idf"))


def _weights(spark, sf, params):
    _, tf, vocab = _fit_train(spark, sf, params)
    out = TF.transform(tf, vocab, "paper_id")
    return out.select("paper_id", "term", "idx", round4("value").alias("value"))


def q_count_vectorize(spark, sf):
    return _weights(spark, sf, TF.COUNT)


def q_tfidf(spark, sf):
    return _weights(spark, sf, TF.TFIDF)


def q_tf_sublinear(spark, sf):
    return _weights(spark, sf, TF.VectorizerParams(sublinear_tf=True))


def q_norm_l1(spark, sf):
    return _weights(spark, sf, TF.VectorizerParams(norm="l1", smooth_idf=False,
                                                   sublinear_tf=True))


def q_norm_l2(spark, sf):
    p = TF.VectorizerParams(ngram_range=(1, 2)).with_stop_words(True)
    return _weights(spark, sf, p)


def q_tfidf_transform_test(spark, sf):
    docs, tf, vocab = _fit_train(spark, sf)
    test = docs.where("split = 'test'")
    feats = TF.keep_empty_rows(TF.transform(tf.where("split = 'test'"), vocab, "paper_id"), test, "paper_id")
    return feats.select("paper_id", "term", "idx", round4("value").alias("value"))


def q_hash_vectorize(spark, sf):
    tf = TF.term_frequencies(one_text(spark, sf, split=False), "paper_id", "text", TF.TFIDF, grouped=True)
    out = hash_features(tf, "paper_id", DEFAULT_WIDTH, "l2")
    return out.select("paper_id", "idx", round4("value").alias("value"))


def q_feature_union(spark, sf):
    _, tf_all, vocab = _fit_train(spark, sf)
    counts = TF.transform(tf_all, TF.FittedVocabulary(vocab.table, vocab.size, vocab.n_docs,
                                                      TF.COUNT), "paper_id")
    tfidf = TF.transform(tf_all, vocab, "paper_id")
    hashed = hash_features(tf_all, "paper_id", DEFAULT_WIDTH, "l2")
    v = vocab.size
    blocks = (tfidf.select("paper_id", "idx", "value")
              .unionByName(TF.offset(counts.select("paper_id", "idx", "value"), v))
              .unionByName(TF.offset(hashed.select("paper_id", "idx", "value"), 2 * v)))
    return blocks.select("paper_id", "idx", round4("value").alias("value"))


COLUMN_TEXTS = ("kw", "title_t", "abstract_t", "venue")


def column_features(tok: DataFrame, fit, params_by_col=None):
    """F23 + F24: one vocabulary per text column (lower-casing off), blocks side
    by side, then year and citations unscaled. ``fit`` marks the rows to fit on.
    Returns (features, width)."""
    params_by_col = params_by_col or {}
    texts = [(c, params_by_col.get(c, TF.VectorizerParams(lowercase=False))) for c in COLUMN_TEXTS]
    blocks, width = TF.block_features(tok, "paper_id", texts, fit, tok.where(fit).count())
    numbers = TF.numeric_block(tok, "paper_id", ["year", "n_citation"], width)
    return blocks.unionByName(numbers.select("paper_id", "idx", "value")), width + 2


def q_column_tfidf(spark, sf):
    feats, _ = column_features(tokenized(spark, sf), F.col("split") == "train")
    return feats.select("paper_id", "idx", round4("value").alias("value"))


QUERIES = {
    "row_ids": q_row_ids,
    "union_splits": q_union_splits,
    "split_counts": q_split_counts,
    "positional_split": q_positional_split,
    "typed_casts": q_typed_casts,
    "paper_rejects": q_paper_rejects,
    "contiguous_folds": q_contiguous_folds,
    "lower_ascii": q_lower_ascii,
    "keyword_summary": q_keyword_summary,
    "symbol_split": q_symbol_split,
    "treebank_tokens": q_treebank_tokens,
    "period_split": q_period_split,
    "core_tokenize": q_core_tokenize,
    "record_tokenize": q_record_tokenize,
    "concat_text": q_concat_text,
    "typed_features": q_typed_features,
    "analyze_terms": q_analyze_terms,
    "ngram_terms": q_ngram_terms,
    "stopword_filter": q_stopword_filter,
    "vocabulary": q_vocabulary,
    "count_vectorize": q_count_vectorize,
    "idf_smooth": q_idf_smooth,
    "idf_raw": q_idf_raw,
    "tf_sublinear": q_tf_sublinear,
    "norm_l1": q_norm_l1,
    "norm_l2": q_norm_l2,
    "tfidf": q_tfidf,
    "tfidf_transform_test": q_tfidf_transform_test,
    "hash_vectorize": q_hash_vectorize,
    "feature_union": q_feature_union,
    "column_tfidf": q_column_tfidf,
}


def _register_more():
    from quire.plans import fit_queries, model_queries, sequence_queries
    QUERIES.update(sequence_queries.QUERIES)
    QUERIES.update(model_queries.QUERIES)
    QUERIES.update(fit_queries.QUERIES)


_register_more()
