import math

from pyspark.sql import functions as F

from quire.functions import analyzers as AZ
from quire.operators import tfidf as TF
from quire.operators.hashing import hash_features
from quire.operators import sequences as SQ
from quire.operators import embeddings as EM


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def test_analyzer_terms(spark):
    got = docs(spark, ["ca n't u.s. a_b"]).select(AZ.analyze("text")).first()[0]
    assert got == ["ca", "a_b"]


def test_ngrams(spark):
    got = docs(spark, ["a1 b1 c1"]).select(AZ.analyzer("text", (1, 3))).first()[0]
    assert got == ["a1", "b1", "c1", "a1 b1", "b1 c1", "a1 b1 c1"]
    short = docs(spark, ["a1"]).select(AZ.analyzer("text", (1, 3))).first()[0]
    assert short == ["a1"]


def test_stop_words_drop_every_occurrence(spark):
    got = docs(spark, ["the cat the hat cat"]).select(
        AZ.remove_stop_words(AZ.analyze("text"), AZ.ENGLISH_STOP_WORDS)).first()[0]
    assert got == ["cat", "hat", "cat"]


def _fit(spark, params):
    d = docs(spark, ["bb aa bb", "bb cc"])
    tf = TF.term_frequencies(d, "id", "text", params)
    return d, tf, TF.fit_vocabulary(tf, 2, params)


def test_idf_smooth_and_raw(spark):
    _, _, v = _fit(spark, TF.TFIDF)
    idf = {r.term: round(r.idf, 4) for r in v.table.collect()}
    assert idf == {"bb": 1.0, "aa": 1.4055, "cc": 1.4055}
    _, _, v = _fit(spark, TF.VectorizerParams(smooth_idf=False))
    idf = {r.term: round(r.idf, 4) for r in v.table.collect()}
    assert idf == {"bb": 1.0, "aa": 1.6931, "cc": 1.6931}


def test_vocabulary_is_alphabetical(spark):
    _, _, v = _fit(spark, TF.TFIDF)
    assert [(r.term, r.idx) for r in v.table.orderBy("idx").collect()] == \
        [("aa", 0), ("bb", 1), ("cc", 2)]


def test_sublinear_tf(spark):
    p = TF.VectorizerParams(sublinear_tf=True, norm=None, use_idf=False)
    _, tf, v = _fit(spark, p)
    w = {r.term: round(r.value, 4) for r in TF.transform(tf, v, "id").where("id = 0").collect()}
    assert w == {"bb": 1.6931, "aa": 1.0}


def test_tfidf_l2_first_doc(spark):
    _, tf, v = _fit(spark, TF.TFIDF)
    w = {r.term: round(r.value, 4) for r in TF.transform(tf, v, "id").where("id = 0").collect()}
    assert w == {"bb": 0.8182, "aa": 0.575}


def test_l2_rows_have_unit_norm(spark):
    _, tf, v = _fit(spark, TF.TFIDF)
    norms = TF.transform(tf, v, "id").groupBy("id").agg(F.sqrt(F.sum(F.col("value") ** 2)))
    assert all(abs(r[1] - 1.0) < 1e-9 for r in norms.collect())


def test_unseen_document_keeps_a_row(spark):
    d, tf, v = _fit(spark, TF.TFIDF)
    test = docs(spark, ["zz"])
    feats = TF.transform(TF.term_frequencies(test, "id", "text"), v, "id")
    kept = TF.keep_empty_rows(feats, test, "id").collect()
    assert len(kept) == 1 and kept[0].idx is None


def test_hashing_width_sign_and_norm(spark):
    d = docs(spark, ["aa bb aa cc"])
    out = hash_features(TF.term_frequencies(d, "id", "text"), "id", 16, "l2").collect()
    assert all(0 <= r.idx < 16 for r in out)
    assert abs(sum(r.value ** 2 for r in out) - 1.0) < 1e-9


def test_word_index_by_count_then_first_appearance(spark):
    d = docs(spark, ["b a", "a c"])
    wi = {r.term: r.idx for r in SQ.fit_word_index(d, "id", "text").collect()}
    assert wi == {"a": 1, "b": 2, "c": 3}


def test_pad_sequences(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],)], "s array<int>")
    got = [r[0] for r in df.select(SQ.pad_sequences("s", 3)).collect()]
    assert got == [[3, 4, 5], [1, 0, 0]]


def test_embedding_lookup_known_unknown(spark):
    wi = spark.createDataFrame([("a", 1), ("b", 2)], "term string, idx long")
    vec = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vec array<float>")
    m = {r.term: (r.known, list(r.vec)) for r in EM.embedding_matrix(wi, vec, 2).collect()}
    assert m == {"a": (True, [1.0, 2.0]), "b": (False, [0.0, 0.0])}


def test_stop_words_are_looked_up_in_a_set(spark):
    from quire.functions import analyzers as AZ
    df = spark.createDataFrame([("the cat and the don dog and", 1), (None, 2)], "text string, id long") \
        .select(AZ.remove_stop_words(AZ.analyze("text"), AZ.ENGLISH_STOP_WORDS).alias("t"))
    assert "INSET" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in df.collect()] == [["cat", "dog"], None]
