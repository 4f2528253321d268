"""Registered fits: set-1 runs, tree ensembles on the complete numeric columns
of the papers, the grid search, and the perceptron with given weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quire.functions import analyzers as AZ
from quire.operators import fold_search as FS
from quire.operators import models as MD
from quire.operators import pipeline as PL
from quire.operators import scoring as SC
from quire.operators import tfidf as TF
from quire.operators.search import staged_scores
from quire.operators.splits import fold_of
from quire.plans.common import one_text, round4, tokenized
from quire.plans.runs import run_default, run_grid
from quire.session import durable, scratch_path
from quire.sources.papers import load_table, paper_numbers


def q_lr_tfidf(spark, sf):
    return run_default(spark, sf, "tfidf", "lr")


def q_lr_count(spark, sf):
    return run_default(spark, sf, "count", "lr")


def q_pipeline_predict(spark, sf):
    """The set-3 pipeline (per-column TF-IDF in signed buckets, numbers, least
    squares) fitted on the train papers, saved, loaded, applied to the test papers."""
    tok = tokenized(spark, sf)
    stages = [PL.TextBlocks(inputCols=list(FS.TEXTS), numericCols=list(FS.NUMBERS), width=FS.WIDTH), PL.LeastSquares()]
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=stages).fit(tok.where("split = 'train'")).save(path)
    pred = PipelineModel.load(path).transform(tok.where("split = 'test'"))
    return pred.select("paper_id", round4("prediction").alias("prediction"))


NUMERIC = ["year", "n_citation", "n_kw", "n_title", "n_abstract", "n_venue"]


def numeric_rows(spark, sf):
    """Year, citations and the term counts of the four texts of every paper, as a
    vector, and the bins that a tree needs to see every distinct value."""
    tok = tokenized(spark, sf, split=False)
    counts = [F.size(AZ.analyze(c, False)).alias(n) for c, n in zip(FS.TEXTS, NUMERIC[2:])]
    numbers, n_train = paper_numbers(spark, sf)
    # Texts stay where they are: only numbers meet the row numbers.
    rows = tok.select("paper_id", "label", "year", "n_citation", *counts).join(numbers, "paper_id") \
        .withColumn("split", F.when(F.col("rn") < n_train, "train").otherwise("test"))
    rows = durable(VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(rows))
    distinct = rows.agg(*[F.countDistinct(c) for c in NUMERIC]).first()
    return rows, max(2, max(distinct) + 1)


def _numeric_predictions(spark, sf, estimator):
    """Fit on the numbers of all train papers; predictions of all test papers."""
    rows, bins = numeric_rows(spark, sf)
    model = estimator.setMaxBins(bins).fit(rows.where("split = 'train'"))
    return model.transform(rows.where("split = 'test'")).select("paper_id", round4("prediction").alias("prediction"))


def q_rf_fit(spark, sf):
    return _numeric_predictions(spark, sf, MD.random_forest(n_estimators=1, bootstrap=False, max_depth=1))


def q_gbt_fit(spark, sf):
    return _numeric_predictions(spark, sf, MD.gradient_boosting(n_estimators=2, max_depth=1))


def q_gbt_eta_fit(spark, sf):
    return _numeric_predictions(spark, sf, MD.boosted_trees(n_estimators=3, eta=0.3, max_depth=1))


def q_gb_staged_cv(spark, sf):
    """G2 over the number of boosted trees on the numbers: one fit a fold scores
    all of them."""
    rows, bins = numeric_rows(spark, sf)
    rows = rows.where("split = 'train'")
    rows = rows.withColumn("fold", fold_of("rn", rows.count(), 4))
    settings = [{"n_estimators": n, "max_depth": 1} for n in (1, 2, 3)]
    scored = []
    for fold in range(4):
        one = staged_scores(lambda **p: MD.gradient_boosting(**p).setMaxBins(bins), settings,
                            rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
        scored += [(r["candidate"], fold, r["r2"]) for r in one]
    return spark.createDataFrame(scored, "candidate int, fold int, r2 double").select("candidate", "fold", round4("r2").alias("r2"))


def q_cv_pipeline(spark, sf):
    """G2 around the whole set-3 pipeline (per-column TF-IDF + least squares), all
    576 candidates: scores per candidate and fold, train/test as in the papers view."""
    n = load_table(spark, sf, "documents").count()
    n_train = int(n * 0.8)
    _, _, scores, _ = run_grid(spark, sf, "lr", n_train=n_train, n_test=n - n_train)
    return scores.select("candidate", "fold", round4("r2").alias("r2"))


def q_mlp_score(spark, sf):
    """M3 + M12 with given weights: TF-IDF (fitted on train) of every paper, 100
    units, one output; the weights are a table by vocabulary index."""
    docs = one_text(spark, sf)
    tf = TF.counted_terms(docs, "paper_id", "text")
    vocab = TF.fit_vocabulary(tf.where("split = 'train'"), docs.where("split = 'train'").count())
    features = TF.transform(tf, vocab, "paper_id")
    weights = vocab.table.select("idx", "df", SC.rule_array(SC.HIDDEN, "(((7 * idx + 3 * u) % 13) - 6) / 50.0D").alias("w"))
    h = SC.sparse_layer(features, weights, docs, "paper_id", SC.rule_array(SC.HIDDEN, SC.HIDDEN_BIAS), SC.HIDDEN)
    out = SC.output_unit("h", SC.rule_array(SC.HIDDEN, SC.OUTPUT), SC.OUTPUT_BIAS)
    return h.select("paper_id", round4(out).alias("prediction"))


QUERIES = {
    "mlp_score": q_mlp_score,
    "cv_pipeline": q_cv_pipeline,
    "gb_staged_cv": q_gb_staged_cv,
    "lr_tfidf": q_lr_tfidf,
    "lr_count": q_lr_count,
    "pipeline_predict": q_pipeline_predict,
    "rf_fit": q_rf_fit,
    "gbt_fit": q_gbt_fit,
    "gbt_eta_fit": q_gbt_eta_fit,
}
