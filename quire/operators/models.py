"""Regressors (M1, M4-M6, M11, M12) as Spark ML estimators with the
workload's parameter meanings mapped onto Spark's.

Mapping notes (the silent differences between the libraries):

* random forest ``max_features='auto'`` means all features for a regressor
  -> ``featureSubsetStrategy='all'`` (Spark's own 'auto' is one third);
* forest defaults 100 trees, unlimited depth -> ``numTrees=100,
  maxDepth=30`` (Spark's limit); gradient boosting 100 trees of depth 3,
  rate 0.1;
* ``copy_X``, ``normalize``, ``shrinking``, ``oob_score`` do not change the
  fitted predictions here; they are accepted and ignored;
* boosted trees: Spark does not shrink the first tree (its weight is 1, later
  ones have the learning rate), and starts from 0 instead of the mean;
* the eta/gamma boosted-tree model maps to ``GBTRegressor(stepSize=eta,
  minInfoGain=gamma)``, a first-order approximation of a second-order method.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

SUBSET = {"auto": "all", None: "all", "sqrt": "sqrt", "log2": "log2", "all": "all"}
IGNORED = {"copy_X", "normalize", "shrinking", "oob_score"}


def linear_regression(fit_intercept: bool = True, features: str = "features",
                      label: str = "label", **ignored) -> LinearRegression:
    """M1: ordinary least squares (no penalty)."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=0.0,
                            elasticNetParam=0.0, fitIntercept=fit_intercept,
                            standardization=False, solver="auto", maxIter=100)


def random_forest(n_estimators: int = 100, max_features="auto", bootstrap: bool = True,
                  seed: int = 7, max_depth: int = 30, features: str = "features",
                  label: str = "label", **ignored) -> RandomForestRegressor:
    """M4."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=n_estimators,
                                 featureSubsetStrategy=SUBSET[max_features],
                                 bootstrap=bootstrap, seed=seed, maxDepth=max_depth,
                                 subsamplingRate=1.0)


def gradient_boosting(n_estimators: int = 100, max_features="auto", max_depth: int = 3,
                      learning_rate: float = 0.1, seed: int = 7, features: str = "features",
                      label: str = "label", **ignored) -> GBTRegressor:
    """M5."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=n_estimators,
                        featureSubsetStrategy=SUBSET[max_features], maxDepth=max_depth,
                        stepSize=learning_rate, seed=seed, lossType="squared")


def boosted_trees(n_estimators: int = 100, eta: float = 0.3, gamma: float = 0.0,
                  max_depth: int = 6, seed: int = 7, features: str = "features",
                  label: str = "label", **ignored) -> GBTRegressor:
    """M6 (re-aimed): shrinkage eta, minimum split gain gamma."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=n_estimators,
                        stepSize=eta, minInfoGain=gamma, maxDepth=max_depth, seed=seed,
                        lossType="squared", featureSubsetStrategy="all")


def make_estimator(name: str, **params):
    """Estimator by the workload's short name; mlp and svr have none."""
    if name == "lr":
        return linear_regression(**params)
    if name == "rf":
        return random_forest(**params)
    if name == "gb":
        return gradient_boosting(**params)
    if name == "xgb":
        return boosted_trees(**params)
    raise ValueError(f"unknown regressor {name!r}")


def pipeline(*stages) -> Pipeline:
    """Features then model, fit / predict as one."""
    return Pipeline(stages=list(stages))
