"""Networks with given weights against numpy; joins of hot words."""
import random

import numpy as np
import pytest

from quire.operators import conv as CV
from quire.operators import embeddings as EM
from quire.operators import scoring as SC
from quire.operators import tfidf as TF
from quire.operators.hot_join import hot_join
from quire.operators.vectors import assemble
from quire.plans.runs import Net, run_dense, run_ncnn
from quire.session import stored

DIM, MAXLEN, UNITS = 3, 6, 4


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "train" if i < 8 else "test", float(i % 4), " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 3, 6, 9]))))
            for i in range(14)] + [(14, "test", 1.0, "none of these")]
    docs = spark.createDataFrame(rows, "paper_id long, split string, label double, text string")
    vectors = {w: [draw.uniform(-1, 1) for _ in range(DIM)] for w in words[:8]}
    return rows, docs, vectors, spark.createDataFrame(list(vectors.items()), "word string, vec array<float>")


def flat(text, vectors):
    x = np.zeros((MAXLEN, DIM))
    for p, w in enumerate(text.split()[-MAXLEN:]):
        x[p] = np.float32(vectors.get(w, [0] * DIM))
    return x


def r2(rows, predicted):
    test = [(r[2], p) for r, p in zip(rows, predicted) if r[1] == "test"]
    y, p = map(np.array, zip(*test))
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_dense_net_equals_numpy(corpus):
    rows, docs, vectors, table = corpus
    draw = np.random.default_rng(1)
    w, b, o = draw.normal(size=(MAXLEN, DIM, UNITS)), draw.normal(size=UNITS), draw.normal(size=UNITS)
    scores, pred = run_dense(docs, table, Net(lambda p: w[p], b, o, 0.25), DIM, MAXLEN)
    want = [np.maximum(np.einsum("pd,pdu->u", flat(r[3], vectors), w) + b, 0) @ o + 0.25 for r in rows]
    got = {r.paper_id: r.prediction for r in pred.collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)
    assert scores.first().r2 == pytest.approx(r2(rows, want), abs=1e-4)


def test_convolution_net_equals_numpy(corpus):
    rows, docs, vectors, table = corpus
    draw = np.random.default_rng(2)
    nf, branches = 2, (1, 2, 3)
    f = CV.ConvFilters({k: draw.normal(size=(k, DIM, nf)) for k in branches}, {k: draw.normal(size=nf) for k in branches},
                       DIM, nf, branches)
    hidden, b, o = draw.normal(size=(6, UNITS)), draw.normal(size=UNITS), draw.normal(size=UNITS)
    _, pred = run_ncnn(docs, table, Net(f, b, o, -1.0, hidden), DIM, MAXLEN)
    want = []
    for r in rows:
        x = flat(r[3], vectors)
        pooled = [np.maximum(max(sum(x[t + j] @ f.w[k][j][:, c] for j in range(k)) for t in range(MAXLEN - k + 1)) + f.b[k][c], 0)
                  for k in branches for c in range(nf)]
        want.append(np.maximum(np.array(pooled) @ hidden + b, 0) @ o - 1.0)
    got = {r.paper_id: r.prediction for r in pred.collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)


def test_nets_without_weights_raise(corpus):
    _, docs, _, table = corpus
    for run in (run_dense, run_ncnn):
        with pytest.raises(ValueError):
            run(docs, table)


def test_flattened_rows_keep_their_places(spark):
    matrix = spark.createDataFrame([(1, "a", 3, True, [1.0, 2.0]), (2, "b", 2, False, [0.0, 0.0]), (3, "c", 1, True, [5.0, 6.0])],
                                   "idx long, term string, cnt long, known boolean, vec array<float>")
    seqs = spark.createDataFrame([(0, [2, 1, 2, 3]), (1, []), (2, [3]), (3, [1, 1, 1, 1, 3]), (4, [2, 2])], "id long, seq array<int>")
    got = {r.id: r.flat for r in EM.embed_flatten(seqs, matrix, "id", 2, 5).collect()}
    assert got == {0: [0, 0, 1, 2, 0, 0, 5, 6, 0, 0], 1: [0] * 10, 2: [5, 6] + [0] * 8, 3: [1, 2] * 4 + [5, 6], 4: [0] * 10}


def test_sparse_layer_equals_numpy_and_keeps_empty_rows(spark):
    cells = [(0, 1, 2.0), (0, 7, -1.0), (1, 7, 3.0), (1, 99, 5.0)]
    features = spark.createDataFrame(cells, "id long, idx long, value double")
    weights = spark.createDataFrame([(1, 5, [1.0, -1.0]), (7, 3, [0.5, 2.0])], "idx long, df long, w array<double>")
    h = SC.sparse_layer(features, weights, spark.range(3), "id", SC.rule_array(2, "u - 1.0D"), 2)
    assert {r.id: r.h for r in h.collect()} == {0: [0.5, 0.0], 1: [0.5, 6.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("budget", [1, 300, 10 ** 6])
def test_hot_join_is_the_plain_join(spark, budget):
    draw = random.Random(4)
    rows = [(i, "the") for i in range(300)] + [(i, f"t{draw.randrange(40)}") for i in range(500)] + [(1, None), (2, "unknown")]
    left = spark.createDataFrame(rows, "id long, term string")
    table = stored(spark.createDataFrame([("the", 300, 0.5)] + [(f"t{i}", 500 - i, i / 7) for i in range(40)],
                                         "term string, df long, idf double"), "table")
    got = sorted(map(tuple, hot_join(left, table, "term", "df", 100, "id", budget).collect()))
    want = sorted(map(tuple, left.join(table, "term").select("id", "term", "df", "idf").collect()))
    assert got == want and len(want) == 800


def test_a_term_in_every_paper_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(TF, "VOCABULARY_ROW_BYTES", 16 * 1024 * 1024)  # one row may be broadcast: the most frequent
    docs = spark.createDataFrame([(i, f"the word{i} the pair{i // 2}") for i in range(40)], "id long, text string")
    tf = TF.term_frequencies(docs, "id", "text")
    vocab = TF.fit_vocabulary(tf, 40)
    got = {(r.id, r.term): r.value for r in TF.transform(tf, vocab, "id").collect()}
    monkeypatch.undo()
    want = {(r.id, r.term): r.value for r in TF.transform(tf, vocab, "id").collect()}
    assert len(want) == 120 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_assembled_vectors_are_read_back(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, label double")
    features = spark.createDataFrame([(1, 4, 0.5), (1, 0, 1.5), (1, None, 9.0)], "id long, idx long, value double")
    got = {r.id: r.features for r in assemble(rows, features, 6, "id").collect()}
    assert got[1].size == 6 and dict(zip(got[1].indices.tolist(), got[1].values.tolist())) == {0: 1.5, 4: 0.5}
    assert got[2].size == 6 and not len(got[2].indices)
