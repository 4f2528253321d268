"""The saved pipeline: parameters, persistence, and the same features as elsewhere."""
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quire.operators import pipeline as PL
from quire.operators import tfidf as TF
from quire.operators.models import linear_regression
from quire.session import scratch_path

ROWS = [(i, ["graph plan", "the model the plan", "", "x1 mesh"][i % 4], f"word{i % 3} of data{i % 2} data{i % 2}",
         float(1 + i % 5), 1990 + i, "train" if i < 16 else "test") for i in range(22)]


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(ROWS, "paper_id long, title_t string, abstract_t string, label double, year int, split string").cache()


@pytest.mark.parametrize("params", [{}, {"norm": "l1", "sublinearTf": True, "smoothIdf": False}, {"norm": "none", "useIdf": False},
                                    {"ngramHigh": 2, "stopWords": True, "lowercase": True}])
def test_sparse_blocks_equal_the_vectorizer(papers, params):
    train = papers.where("split = 'train'")
    stage = PL.TextBlocks(inputCols=["title_t"], numericCols=["year"], **params)
    got = {r.paper_id: r.x for r in stage.fit(train).transform(papers).select("paper_id", vector_to_array("features").alias("x")).collect()}
    p = stage.vectorizer()
    vocab = TF.fit_vocabulary(TF.term_frequencies(train, "paper_id", "title_t", p), 16, p)
    want = {i: [0.0] * vocab.size + [float(year)] for i, *_, year, _ in ROWS}
    for r in TF.transform(TF.term_frequencies(papers, "paper_id", "title_t", p), vocab, "paper_id").collect():
        want[r.paper_id][r.idx] = r.value
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


@pytest.mark.parametrize("width", [0, 2])
def test_fit_save_load_transform(spark, papers, width):
    train, test = papers.where("split = 'train'"), papers.where("split = 'test'")
    blocks = PL.TextBlocks(inputCols=["title_t", "abstract_t"], numericCols=["year"], width=width, norm="l1")
    model = Pipeline(stages=[blocks, PL.LeastSquares() if width else linear_regression()]).fit(train)
    path = scratch_path(spark, "pipeline-test")
    model.save(path)
    loaded = PipelineModel.load(path)
    assert loaded.stages[0].getOrDefault("norm") == "l1" and loaded.stages[0].getOrDefault("width") == width
    a = {r.paper_id: r.prediction for r in model.transform(test).collect()}
    b = {r.paper_id: r.prediction for r in loaded.transform(test).collect()}
    assert a.keys() == b.keys() == set(range(16, 22))
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    unfitted = scratch_path(spark, "pipeline-unfitted")
    Pipeline(stages=[blocks]).save(unfitted)
    assert Pipeline.load(unfitted).getStages()[0].getOrDefault("inputCols") == ["title_t", "abstract_t"]


def test_bounded_blocks_and_least_squares_equal_spark(papers):
    rows = PL.TextBlocks(inputCols=["title_t"], numericCols=["year"], width=1).fit(papers).transform(papers)
    ours = {r.paper_id: r.prediction for r in PL.LeastSquares().fit(rows).transform(rows).collect()}
    spark_ml = {r.paper_id: r.prediction for r in linear_regression().setSolver("normal").fit(rows).transform(rows).collect()}
    assert all(ours[i] == pytest.approx(spark_ml[i], abs=1e-6) for i in ours)


def test_a_row_without_terms_and_a_wrong_norm(papers):
    empty = papers.select("paper_id", F.lit("").alias("title_t"))
    model = PL.TextBlocks(inputCols=["title_t"], width=3).fit(papers)
    assert {tuple(r.x) for r in model.transform(empty).select(vector_to_array("features").alias("x")).collect()} == {(0.0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        PL.TextBlocks(inputCols=["title_t"], norm="max").fit(papers)


@pytest.mark.parametrize("norm", ["l2", "l1", "none"])
def test_rare_terms_give_the_same_blocks(spark, monkeypatch, norm):
    from quire.operators import hot_join as HJ
    rows = [(i, f"the w{i % 3} w{i}", f"x{i % 2} the the") for i in range(12)] + [(12, "unseen", "")]
    df = spark.createDataFrame(rows, "paper_id long, a string, b string")
    model = PL.TextBlocks(inputCols=["a", "b"], width=4, norm=norm, lowercase=True).fit(df.where("paper_id < 12"))
    want = {r.paper_id: r.features.toArray().tolist() for r in model.transform(df).collect()}
    monkeypatch.setattr(PL, "BUDGET", 1)
    monkeypatch.setattr(HJ, "BUDGET", 1)
    out = model.transform(df)
    got = {r.paper_id: r.features.toArray().tolist() for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
