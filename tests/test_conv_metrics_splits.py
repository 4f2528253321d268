import numpy as np
from pyspark.sql import functions as F

from quire.functions.metrics import regression_metrics
from quire.operators import conv as CV
from quire.operators import search as S
from quire.operators.splits import contiguous_folds


def test_conv_pool_hand_case(spark):
    # width-1 vectors 1, 2, 0, 0; one filter of width 2 with weights (1, -1), bias 0.5
    f = CV.ConvFilters({2: np.array([[[1.0]], [[-1.0]]])}, {2: np.array([0.5])}, dim=1,
                       n_filters=1, branches=(2,))
    matrix = spark.createDataFrame([(1, 9, True, [1.0]), (2, 5, True, [2.0])],
                                   "idx long, cnt long, known boolean, vec array<float>")
    seqs = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3])], "id long, seq array<int>")
    pooled = CV.conv_pool(seqs, CV.slot_projections(matrix, f), f, "id", maxlen=4)
    out = {r.id: (r.width, r.filter, r.value) for r in CV.pooled_cells(pooled, f, "id").collect()}
    assert out == {0: (2, 0, 2.5), 1: (2, 0, 0.5), 2: (2, 0, 0.5)}


def test_contiguous_fold_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "rn")
    sizes = {r.fold: r["count"] for r in contiguous_folds(df, "rn", 10, 4).groupBy("fold")
             .count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}


def test_metrics_hand_case(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "label double, prediction double")
    r = regression_metrics(df).first()
    assert (r.mse, r.mae, r.r2) == (1.3333, 0.6667, -1.0)


def test_r2_constant_target(spark):
    a = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    b = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    assert regression_metrics(a).first().r2 == 1.0
    assert regression_metrics(b).first().r2 == 0.0


def test_best_candidate_first_wins_ties(spark):
    means = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5)], "candidate int, mean_r2 double")
    assert S.best_candidate(means).first().candidate == 1


def test_param_grid_counts():
    assert len(S.param_grid(S.VECT_GRID)) == 72
    assert len(S.param_grid(S.VECT_GRID, S.MODEL_GRIDS["lr"])) == 576
    assert len(S.param_grid(S.VECT_GRID, S.MODEL_GRIDS["xgb"])) == 172872
    distinct, mapping = S.collapse(S.param_grid(S.MODEL_GRIDS["lr"]), "lr")
    assert len(distinct) == 2 and len(mapping) == 8
