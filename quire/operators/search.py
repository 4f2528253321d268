"""Model selection.

G1 builds the candidate list as the Cartesian product of the vectorizer and
model grids (later keys win, like ``{**a, **b}``). G2 fits every candidate
on every fold's complement and scores the held-out fold; the predictions of
all candidates for one fold are scored in one grouped aggregation. G3 picks
the best mean score (first candidate wins ties) with an aggregate, not a
window. R7 collapses axes that cannot change predictions before fitting and
copies the scores back, and R6 (two-level search) lets the caller build the
features once per (vectorizer setting, fold) and run all model settings on
them.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.metrics import score_aggs

# The search grids of the workload (set 3).
VECT_GRID = {
    "ngram_range": [(1, 1), (1, 2), (1, 3)],
    "norm": ["l1", "l2", None],
    "smooth_idf": [True, False],
    "stop_words": ["english", None],
    "sublinear_tf": [True, False],
}
MODEL_GRIDS = {
    "lr": {"copy_X": [True, False], "fit_intercept": [True, False], "normalize": [True, False]},
    "svr": {"C": [0.01, 0.1, 1, 10, 100], "gamma": ["scale", "auto"],
            "kernel": ["linear", "poly", "rbf", "sigmoid"], "shrinking": [True, False]},
    "mlp": {"hidden_layer_sizes": [(50,), (75,), (100,), (125,), (150,)],
            "alpha": [0.00005, 0.0001, 0.0005, 0.001, 0.005],
            "solver": ["lbfgs", "sgd", "adam"]},
    "rf": {"n_estimators": [50, 60, 70, 85, 100, 150, 200],
           "max_features": ["auto", "sqrt", "log2"],
           "bootstrap": [True, False], "oob_score": [True, False]},
    "gb": {"n_estimators": [50, 60, 70, 85, 100, 150, 200],
           "max_features": ["auto", "sqrt", "log2"],
           "max_depth": [2, 3, 4, 5, 6, 7, 8]},
    "xgb": {"n_estimators": [50, 60, 70, 85, 100, 150, 200],
            "eta": [0.008, 0.015, 0.03, 0.05, 0.1, 0.15, 0.3],
            "gamma": [0.002, 0.005, 0.01, 0.05, 0.1, 0.15, 0.2],
            "max_depth": [2, 3, 4, 5, 6, 7, 8]},
}

#: Models that add tree after tree.
BOOSTED = ("gb", "xgb")
# Axes that do not change the fitted predictions of the given model.
NO_EFFECT = {"lr": {"copy_X", "normalize"}, "svr": {"shrinking"}, "rf": {"oob_score"}}


def param_grid(*grids: dict) -> list[dict]:
    """G1: Cartesian product of the grids, in key order, as a list of dicts."""
    merged: dict = {}
    for g in grids:
        merged.update(g)
    keys = list(merged)
    return [dict(zip(keys, values)) for values in itertools.product(*(merged[k] for k in keys))]


def collapse(grid: list[dict], model: str) -> tuple[list[dict], list[int]]:
    """Drop no-effect axes (and gamma for linear kernels); returns the
    distinct settings and, per original candidate, its setting number."""
    drop = NO_EFFECT.get(model, set())
    seen: dict = {}
    mapping = []
    for p in grid:
        q = {k: v for k, v in p.items() if k not in drop}
        if model == "svr" and q.get("kernel") == "linear":
            q.pop("gamma", None)
        key = repr(sorted(q.items(), key=lambda kv: kv[0]))
        if key not in seen:
            seen[key] = (len(seen), q)
        mapping.append(seen[key][0])
    distinct = [q for _, q in sorted(seen.values(), key=lambda t: t[0])]
    return distinct, mapping


def fold_scores(predictions: DataFrame, label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Scores per (candidate, fold) from a union of prediction tables."""
    return predictions.groupBy("candidate", "fold").agg(*score_aggs(label, prediction, None))


def cross_validate(make_estimator, settings: list[dict], data: DataFrame, k: int,
                   fold_col: str = "fold", label: str = "label",
                   prediction: str = "prediction", parallelism: int = 1,
                   prepare=None) -> DataFrame:
    """(candidate, fold, n, mse, mae, r2) for every setting and fold.

    ``prepare(train, valid)`` may turn raw fold rows into model inputs (R6:
    features fitted once per fold, shared by all settings).
    """
    parts = []
    for fold in range(k):
        train = data.where(F.col(fold_col) != fold)
        valid = data.where(F.col(fold_col) == fold)
        if prepare is not None:
            train, valid = prepare(train, valid)
        train = train.persist()

        def fit_one(i):
            model = make_estimator(**settings[i]).fit(train)
            return (model.transform(valid)
                    .select(F.lit(i).alias("candidate"), F.lit(fold).alias("fold"),
                            F.col(label).alias("label"), F.col(prediction).alias("prediction")))

        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as pool:
                preds = list(pool.map(fit_one, range(len(settings))))
        else:
            preds = [fit_one(i) for i in range(len(settings))]
        fold_pred = preds[0]
        for p in preds[1:]:
            fold_pred = fold_pred.unionByName(p)
        # one small table per fold (a row per candidate), kept for the union
        scored = fold_scores(fold_pred).cache()
        scored.count()
        parts.append(scored)
        train.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def staged_scores(make_estimator, settings: list[dict], train: DataFrame, valid: DataFrame,
                  axis: str = "n_estimators", label: str = "label") -> list[dict]:
    """G2 for boosted trees: settings that differ in the number of trees alone
    share one fit of the largest. Boosting adds tree after tree, so a smaller
    model is the larger one's prefix; one pass over ``valid`` gives the error
    after every tree. Rows of ``candidate``, ``n``, ``mse``, ``r2``."""
    alike: dict = {}
    for i, s in enumerate(settings):
        alike.setdefault(repr(sorted((k, v) for k, v in s.items() if k != axis)), []).append(i)
    n, spread = valid.agg(F.count(F.lit(1)), F.var_pop(label)).first()
    out = []
    for members in alike.values():
        most = max(settings[i][axis] for i in members)
        errors = make_estimator(**(settings[members[0]] | {axis: most})).fit(train).evaluateEachIteration(valid, "squared")
        for i in members:
            mse = errors[settings[i][axis] - 1]
            r2 = 1.0 - mse / spread if spread else float(mse == 0)
            out.append({"candidate": i, "n": n, "mse": mse, "r2": r2})
    return sorted(out, key=lambda r: r["candidate"])


def mean_scores(scores: DataFrame, metric: str = "r2") -> DataFrame:
    """Mean held-out score per candidate."""
    return scores.groupBy("candidate").agg(F.avg(metric).alias(f"mean_{metric}"))


def best_candidate(means: DataFrame, metric: str = "mean_r2") -> DataFrame:
    """Highest mean score; the first candidate wins ties."""
    key = F.struct((-F.col(metric)).alias("s"), F.col("candidate").alias("c"))
    return means.agg(F.min_by("candidate", key).alias("candidate"),
                     F.max(metric).alias(metric))


def expand(scores: DataFrame, mapping: list[int]) -> DataFrame:
    """Copy the scores of a distinct setting to every equivalent candidate."""
    spark = scores.sparkSession
    m = spark.createDataFrame(list(enumerate(mapping)),
                              T.StructType([T.StructField("orig", T.IntegerType()),
                                            T.StructField("candidate", T.IntegerType())]))
    return (F.broadcast(m).join(scores, "candidate")
            .drop("candidate").withColumnRenamed("orig", "candidate"))
