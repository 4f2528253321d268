import random

import pytest

from quire.operators import conv as CV
from quire.operators import embeddings as EM
from quire.operators import in_place
from quire.operators import sequences as SQ
from quire.plans import sequence_queries
from quire.session import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def words(spark):
    draw = random.Random(3)
    matrix = stored(spark.createDataFrame([(i, f"t{i}", 50 - i, i % 4 > 0, [float(i), -i / 2]) for i in range(1, 30)],
                                          "idx long, term string, cnt long, known boolean, vec array<float>"), "matrix")
    rows = [(i, [draw.randrange(1, 34) for _ in range(draw.choice([0, 1, 5, 9]))]) for i in range(150)]
    return matrix, rows, stored(spark.createDataFrame(rows, "id long, seq array<int>"), "seqs")


@pytest.mark.parametrize("budget", [1, 500, 10 ** 6])
def test_flattened_rows_with_rare_words(words, monkeypatch, budget):
    matrix, rows, seqs = words
    monkeypatch.setattr(in_place, "BUDGET", budget)
    got = {r.id: r.flat for r in EM.embed_flatten(seqs, matrix, "id", 2, 9).collect()}
    want = {i: sum(([float(w), -w / 2] if w < 30 and w % 4 else [0.0, 0.0] for w in seq), []) + [0.0] * (18 - 2 * len(seq))
            for i, seq in rows}
    assert got == want


def test_flattened_rows_are_summed_where_they_are_made(words):
    matrix, rows, seqs = words
    of = {"fsum": sequence_queries._sums, "wsum": sequence_queries._position_sums}
    flat = EM.embed_flatten(seqs, matrix, "id", 2, 9, of_rows=of)
    for r in flat.collect():
        assert len(r.flat) == 18
        total = weighted = 0.0
        for i, x in enumerate(r.flat):
            total, weighted = total + x, weighted + x * (i % 5 + 1)
        assert (r.fsum, r.wsum) == (total, weighted)


def test_no_lambda_over_flattened_rows(spark, monkeypatch):
    """The registered query makes whole rows and folds none of their numbers in SQL."""
    made = {}
    flatten = EM.embed_flatten
    monkeypatch.setattr(EM, "embed_flatten", lambda *a, **b: made.setdefault("flat", flatten(*a, **b)))
    out = plan(sequence_queries.q_embed_flatten(spark, "/root/testdata/sf0.001"))
    assert "lambda" not in out and "aggregate(flat" not in out
    assert {len(r.flat) for r in made["flat"].select("flat").limit(5).collect()} == {400 * 64}


@pytest.mark.parametrize("budget", [1, 10 ** 6])
def test_pooled_windows_with_rare_words(words, monkeypatch, budget):
    matrix, rows, seqs = words
    f = CV.rule_filters(2, 3)
    want = {}
    for i, seq in rows:
        x = [[float(w), -w / 2] if w < 30 and w % 4 else [0.0, 0.0] for w in seq] + [[0.0, 0.0]] * (9 - len(seq))
        want[i] = [max(0.0, max(sum(a * b for j in range(k) for a, b in zip(x[t + j], f.w[k][j][:, c])) for t in range(10 - k)) + f.b[k][c])
                   for k in f.branches for c in range(3)]
    monkeypatch.setattr(in_place, "BUDGET", budget)
    got = {r.id: r.pooled for r in CV.conv_pool(seqs, CV.slot_projections(matrix, f), f, "id", 9).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_frequent_words_vectors_are_not_shuffled(words):
    matrix, _, seqs = words
    assert "Exchange" not in plan(EM.embed_flatten(seqs, matrix, "id", 2, 9))
    f = CV.rule_filters(2, 3)
    assert "Exchange" not in plan(CV.conv_pool(seqs, CV.slot_projections(matrix, f), f, "id", 9))


def test_positions_are_a_row_per_document(words):
    matrix, rows, seqs = words
    got = {r.id: (r.pos, r.vecs) for r in EM.embed_positions(seqs, matrix, "id", 2).collect()}
    assert got == {i: ([p for p, w in enumerate(seq) if w < 30 and w % 4],
                       sum(([float(w), -w / 2] for w in seq if w < 30 and w % 4), [])) for i, seq in rows}


def test_word_index_sums_numbers_without_a_sort(spark, monkeypatch):
    plans, real = [], SQ.with_row_index
    monkeypatch.setattr(SQ, "with_row_index", lambda df, *a, **k: (plans.append(plan(df)), real(df, *a, **k))[1])
    docs = spark.createDataFrame([(7, "b a b c"), (2, "c d d"), (9, "e a d")], "id long, text string")
    index = SQ.fit_word_index(docs, "id", "text")
    assert [(r.term, r.cnt) for r in index.orderBy("idx").collect()] == [("d", 3), ("c", 2), ("b", 2), ("a", 2), ("e", 1)]
    assert "SortAggregate" not in plans[0]
    got = {r.id: r.seq for r in SQ.texts_to_sequences(docs, index, "id", "text").collect()}
    assert got == {7: [3, 4, 3, 2], 2: [2, 1, 1], 9: [5, 4, 1]}


@pytest.mark.parametrize("row_bytes", [16 * 1024 * 1024, 8])
def test_sequences_with_rare_words(spark, monkeypatch, row_bytes):
    monkeypatch.setattr(SQ, "INDEX_ROW_BYTES", row_bytes)
    docs = spark.createDataFrame([(i, f"the w{i % 5} the x{i}") for i in range(20)] + [(99, "")], "id long, text string")
    index = SQ.fit_word_index(docs, "id", "text")
    at = {r.term: r.idx for r in index.collect()}
    got = {r.id: r.seq for r in SQ.texts_to_sequences(docs, index, "id", "text").collect()}
    assert got == {i: [at["the"], at[f"w{i % 5}"], at["the"], at[f"x{i}"]] for i in range(20)} | {99: []}
