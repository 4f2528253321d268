"""Fits wider than a driver holds against Spark's own."""
import random

import numpy as np
import pytest

from quire.operators import wide_least_squares as W
from quire.operators.models import linear_regression
from quire.operators.vectors import assemble
from quire.plans import runs
from quire.plans.runs import run_default


def table(spark, n=70, width=40):
    draw = random.Random(5)
    rows = [(i, float(draw.randint(1, 30)) if i < n - 1 else 4.5) for i in range(n)]
    cells = [(i, j, draw.choice([1.0, 2.0, 0.3])) for i, _ in rows[:-2] for j in sorted(draw.sample(range(width), draw.randint(1, 6)))]
    cells += [(i, width, 2.5) for i, _ in rows]  # a column without a deviation
    return (spark.createDataFrame(rows, "id long, label double"), spark.createDataFrame(cells, "id long, idx long, value double"),
            width + 1)


def test_same_steps_as_sparks_solver(spark):
    rows, cells, width = table(spark)
    vectors = assemble(rows, cells, width, "id")
    spark_ml = linear_regression().setSolver("l-bfgs").fit(vectors)
    model = W.fit_wide(rows, cells, "id")
    w = np.zeros(width)
    for r in model.weights.collect():
        w[r.idx] = r.w
    assert w == pytest.approx(spark_ml.coefficients.toArray(), abs=1e-6)
    assert model.intercept == pytest.approx(spark_ml.intercept, abs=1e-6)
    want = {r.id: r.prediction for r in spark_ml.transform(vectors).collect()}
    got = {r.id: r.prediction for r in model.predict(rows, cells, "id").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_labels_that_are_all_the_same_and_rows_without_features(spark):
    rows, cells, _ = table(spark)
    same = rows.selectExpr("id", "3.0D as label")
    assert {r.prediction for r in W.fit_wide(same, cells, "id").predict(same, cells, "id").collect()} == {3.0}
    none = W.fit_wide(rows, cells.where("id < 0"), "id")
    mean = np.mean([r.label for r in rows.collect()])
    assert {round(r.prediction, 9) for r in none.predict(rows, cells, "id").collect()} == {round(mean, 9)}


def test_repeated_and_null_ids_and_cells_of_other_ids(spark):
    rows, cells, width = table(spark)
    rows = rows.unionByName(rows.where("id < 9").selectExpr("id", "label + 2 as label")).unionByName(spark.sql("select cast(null as long) as id, 6.0D as label"))
    other = cells.unionByName(cells.where("id < 5").selectExpr("id + 1000 as id", "idx", "value"))
    vectors = assemble(rows, cells, width, "id")
    spark_ml = linear_regression().setSolver("l-bfgs").fit(vectors)
    model = W.fit_wide(rows, other, "id")
    w = {r.idx: r.w for r in model.weights.collect()}
    assert [w.get(i, 0.0) for i in range(width)] == pytest.approx(list(spark_ml.coefficients), abs=1e-6)
    assert model.intercept == pytest.approx(spark_ml.intercept, abs=1e-6)


@pytest.mark.parametrize("vectorizer", ["tfidf", "count"])
def test_wide_vocabularies_are_not_fitted_on_the_driver(spark, monkeypatch, vectorizer):
    """More terms than the normal equations take: no vector of that width is made."""
    draw = random.Random(7)
    rows = [(i, "train" if i < 80 else "test", float(i % 9), " ".join(f"w{draw.randrange(9000)}" for _ in range(110)) + f" k{i % 9}k")
            for i in range(100)]
    docs = spark.createDataFrame(rows, "paper_id long, split string, label double, text string")
    monkeypatch.setattr(W, "WIDEST_NORMAL", 10 ** 9)
    want = run_default(spark, None, vectorizer, docs=docs).first()
    monkeypatch.undo()
    monkeypatch.setattr(runs, "assemble", lambda *a: pytest.fail("a vector as wide as the vocabulary"))
    got = run_default(spark, None, vectorizer, docs=docs).first()
    assert got[:5] == want[:5] and got[5:] == pytest.approx(want[5:], abs=2e-3)


def test_memory_of_steps_is_in_a_file():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 300))
    x -= x.mean(axis=0)
    y = rng.standard_normal(50)
    y -= y.mean()
    fitted = W.fit_by_rows(lambda r: x @ (x.T @ r), y)
    assert x @ (x.T @ fitted) == pytest.approx(y, abs=1e-2)
