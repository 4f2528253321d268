"""Registered queries for fitting, scoring and model selection.

The oracle-checked ones use one numeric feature (the number of analyzer
terms of a paper's one-text column), so least squares, its cross-validated
R^2 and the winner can be recomputed in SQL with ``regr_slope`` /
``regr_intercept``. The tree and network fits are checked by row count.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import analyzers as AZ
from quire.functions.metrics import regression_metrics
from quire.operators import search as S
from quire.operators.least_squares import cross_validate_least_squares
from quire.operators.models import linear_regression
from quire.operators.splits import fold_of
from quire.plans.common import one_text, round4
from quire.session import durable
from quire.sources.papers import paper_numbers

LR_SETTINGS = [{"fit_intercept": True}, {"fit_intercept": False}]


def one_feature(spark: SparkSession, sf: str) -> DataFrame:
    d = one_text(spark, sf, split=False)
    x = F.size(AZ.analyze("text")).cast("double")
    numbers, n_train = paper_numbers(spark, sf)
    # Texts stay where they are: only (id, x, label) meets the row numbers.
    rows = d.select("paper_id", "label", x.alias("x")).join(numbers, "paper_id") \
        .withColumn("split", F.when(F.col("rn") < n_train, "train").otherwise("test"))
    # small (one number a paper) and re-read by every fold and candidate
    return durable(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))


def _fit(train: DataFrame, fit_intercept: bool):
    return linear_regression(fit_intercept=fit_intercept).fit(train)


def q_lr_simple(spark, sf):
    data = one_feature(spark, sf)
    train = data.where("split = 'train'").persist()
    rows = []
    for s in LR_SETTINGS:
        m = _fit(train, s["fit_intercept"])
        rows.append((s["fit_intercept"], float(m.coefficients[0]), float(m.intercept)))
    train.unpersist()
    out = spark.createDataFrame(rows, "fit_intercept boolean, slope double, intercept double")
    return out.select("fit_intercept", round4("slope").alias("slope"),
                      round4("intercept").alias("intercept"))


def q_regression_metrics(spark, sf):
    data = one_feature(spark, sf)
    model = _fit(data.where("split = 'train'"), True)
    pred = model.transform(data.where("split = 'test'"))
    return regression_metrics(pred, "label", "prediction")


def _cv(spark, sf):
    """Every intercept setting on every fold, from one aggregate of the folds."""
    data = one_feature(spark, sf)
    train = data.where("split = 'train'")
    folded = train.withColumn("fold", fold_of("rn", train.count(), 4))
    scored = cross_validate_least_squares(folded, ["x"], [s["fit_intercept"] for s in LR_SETTINGS])
    return spark.createDataFrame([(r["candidate"], r["fold"], r["r2"]) for r in scored],
                                 "candidate int, fold int, r2 double"), data


def q_cv_scores(spark, sf):
    scores, _ = _cv(spark, sf)
    return scores.select("candidate", "fold", round4("r2").alias("r2"))


def q_best_candidate(spark, sf):
    scores, _ = _cv(spark, sf)
    best = S.best_candidate(S.mean_scores(scores))
    return best.select("candidate", round4("mean_r2").alias("mean_r2"))


def _best_model(spark, sf):
    scores, data = _cv(spark, sf)
    best = S.best_candidate(S.mean_scores(scores)).first()["candidate"]
    model = linear_regression(**LR_SETTINGS[best]).fit(data.where("split = 'train'"))
    return model, data


def q_best_predict(spark, sf):
    model, data = _best_model(spark, sf)
    pred = model.transform(data.where("split = 'test'"))
    return pred.select("paper_id", round4("prediction").alias("prediction"))


def q_compare_models(spark, sf):
    best, data = _best_model(spark, sf)
    default = linear_regression().fit(data.where("split = 'train'"))
    test = data.where("split = 'test'")
    a = default.transform(test).select(F.lit("default").alias("model"), "label", "prediction")
    b = best.transform(test).select(F.lit("best").alias("model"), "label", "prediction")
    return regression_metrics(a.unionByName(b), by="model")


QUERIES = {
    "lr_simple": q_lr_simple,
    "regression_metrics": q_regression_metrics,
    "cv_scores": q_cv_scores,
    "best_candidate": q_best_candidate,
    "best_predict": q_best_predict,
    "compare_models": q_compare_models,
}
