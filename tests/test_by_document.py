import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import analyzers as AZ
from quire.operators import by_document as BD
from quire.operators import sequences as SQ
from quire.operators import tfidf as TF
from quire.operators.hashing import hash_features, signed_hash


def texts(n=300, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["the", "Über", "a1"]
    out = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 40])))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (None, "lost w1 w1"), (7, "w1 w2 w1"), (None, "w1 again")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(texts(), "id long, text string").withColumn("split", F.when(F.col("id") < 200, "train"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_terms_are_counted_by_document_in_pieces(spark, docs, piece, monkeypatch):
    monkeypatch.setattr(BD, "PIECE", piece)
    p = TF.VectorizerParams(ngram_range=(1, 2)).with_stop_words(True)
    plain = docs.select("id", "split", F.explode(AZ.analyzer("text", (1, 2), p.stop_words)).alias("term")) \
        .groupBy("id", "split", "term").agg(F.count(F.lit(1)).alias("tf"))
    got = TF.term_frequencies(docs, "id", "text", p, ("split",))
    assert rows(got) == rows(plain)
    # no row per occurrence, no aggregate over such rows
    assert "Aggregate" not in plan(got) and "Generate" not in plan(got)
    lists = TF.term_frequencies(docs, "id", "text", p, ("split",), grouped=True)
    assert rows(lists.select("id", "split", F.inline(F.arrays_zip("term", "tf")))) == rows(plain)
    assert lists.count() == docs.select("id").distinct().count()


@pytest.mark.parametrize("norm", ["l2", "l1", None])
def test_hashing_sums_and_norms_where_the_document_lies(spark, docs, norm):
    tf = TF.term_frequencies(docs, "id", "text")
    h = signed_hash("term")
    want = {}
    for r in tf.select("id", (F.abs(h) % 16).alias("idx"), F.when(h >= 0, F.col("tf")).otherwise(-F.col("tf")).alias("v")).collect():
        want.setdefault(r.id, {}).setdefault(r.idx, 0)
        want[r.id][r.idx] += r.v
    sizes = {i: {"l2": math.sqrt(sum(v * v for v in c.values())), "l1": sum(map(abs, c.values())), None: 1}[norm] for i, c in want.items()}
    want = {(i, idx): v / sizes[i] for i, c in want.items() for idx, v in c.items() if v}
    for form in (tf, TF.term_frequencies(docs, "id", "text", grouped=True)):
        got = hash_features(form, "id", 16, norm)
        assert {(r.id, r.idx): r.value for r in got.collect()} == pytest.approx(want)
        assert got.count() == len(want)
    assert "Window" not in plan(got) and "HashAggregate" not in plan(got)


def test_words_are_indexed_without_moving_texts(spark, docs):
    own = docs.where("id is not null").dropDuplicates(["id"])
    got = [(r.term, r.idx, r.cnt) for r in SQ.fit_word_index(own, "id", "text").orderBy("idx").collect()]
    seen = {}
    for r in own.orderBy("id").collect():
        for pos, w in enumerate((r.text or "").lower().split()):
            c = seen.setdefault(w, [0, (r.id, pos)])
            c[0] += 1
    order = sorted(seen, key=lambda w: (-seen[w][0], seen[w][1]))
    assert got == [(w, i + 1, seen[w][0]) for i, w in enumerate(order)]


def test_sequences_are_the_same_when_rare_words_are_shuffled(spark, docs):
    own = docs.where("id is not null").dropDuplicates(["id"]).repartition(3)
    wi = SQ.fit_word_index(own.where("id < 250"), "id", "text")
    index = {r.term: r.idx for r in wi.collect()}
    want = [(r.id, [index[w] for w in (r.text or "").lower().split() if w in index]) for r in own.collect()]
    for budget in (1 << 20, 12 * SQ.INDEX_ROW_BYTES):
        got = SQ.texts_to_sequences(own, wi, "id", "text", budget)
        assert rows(got) == sorted(want, key=repr)


def test_one_text_is_not_joined_with_labels(spark):
    from quire.plans.common import one_text
    out = one_text(spark, "/root/testdata/sf0.001", split=False)
    assert "Join" not in plan(out)
