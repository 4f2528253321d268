"""The workload's four entry points (section 2.7) as Spark jobs.

* :func:`run_default` -- one text column, vectorizer x regressor with
  default parameters, scores on the test rows;
* :func:`run_dense`, :func:`run_ncnn` -- padded index sequences with static word
  vectors, scored by a dense net / n-gram convolution net with given weights;
* :func:`run_grid` -- per-column TF-IDF + numeric columns, default model and
  a grid search over vectorizer x model settings (``quire.operators.search``).

Each returns DataFrames; nothing is printed. Unknown choices raise
``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.metrics import regression_metrics
from quire.operators import tfidf as TF
from quire.operators import wide_least_squares as WLS
from quire.operators.hashing import DEFAULT_WIDTH, hash_features
from quire.operators.models import make_estimator
from quire.operators.vectors import assemble
from quire.plans.common import one_text
from quire.session import durable, stored

VECTORIZERS = ("tfidf", "count", "hash", "union")
REGRESSORS_DEFAULT = ("lr",)
NOT_TRAINED = {"mlp": "score given weights with quire.operators.scoring", "svr": "its kernels are not built"}


def text_features(docs: DataFrame, vectorizer: str, id_col: str = "paper_id",
                  text_col: str = "text") -> tuple[DataFrame, int]:
    """Long-form features of ``docs`` for one of tfidf, count, hash, union,
    fitted on the rows whose ``split`` is train. Returns (features, width)."""
    if vectorizer not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer {vectorizer!r}; choose one of {VECTORIZERS}")
    tf = TF.counted_terms(docs, id_col, text_col, TF.TFIDF)
    if vectorizer == "hash":
        return hash_features(tf, id_col, DEFAULT_WIDTH, "l2"), DEFAULT_WIDTH
    vocab = TF.fit_vocabulary(tf.where("split = 'train'"), docs.where("split = 'train'").count(), TF.TFIDF)
    counts_vocab = TF.FittedVocabulary(vocab.table, vocab.size, vocab.n_docs, TF.COUNT)
    tfidf = TF.transform(tf, vocab, id_col).select(id_col, "idx", "value")
    if vectorizer == "tfidf":
        return tfidf, vocab.size
    counts = TF.transform(tf, counts_vocab, id_col).select(id_col, "idx", "value")
    if vectorizer == "count":
        return counts, vocab.size
    hashed = hash_features(tf, id_col, DEFAULT_WIDTH, "l2")
    v = vocab.size
    union = (tfidf.unionByName(TF.offset(counts, v))
             .unionByName(TF.offset(hashed.select(id_col, "idx", "value"), 2 * v)))
    return union, 2 * v + DEFAULT_WIDTH


def fit_predict(estimator, train_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Fit on durable training rows, predict the test rows."""
    model = estimator.fit(durable(train_rows))
    return model.transform(test_rows)


def run_default(spark: SparkSession, sf_dir: str | None, vectorizer: str = "tfidf",
                regressor: str = "lr", docs: DataFrame | None = None) -> DataFrame:
    """Set 1: one row (vectorizer, regressor, n_train, n_val, n_test, mse, mae, r2).

    ``docs`` are the caller's own papers (``paper_id``, ``split``, ``label``,
    ``text``; see ``quire.plans.common.one_text_of``); without them the papers
    view of ``sf_dir`` is taken."""
    if vectorizer not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer {vectorizer!r}; choose one of {VECTORIZERS}")
    if regressor in NOT_TRAINED:
        raise ValueError(f"{regressor!r} cannot be fitted: Spark has no such learner; {NOT_TRAINED[regressor]}")
    if regressor not in REGRESSORS_DEFAULT:
        raise ValueError(f"unknown regressor {regressor!r}; choose one of {REGRESSORS_DEFAULT}")
    docs = one_text(spark, sf_dir) if docs is None else docs
    train = docs.where("split = 'train'")
    test = docs.where("split = 'test'")
    feats, width = text_features(docs, vectorizer)
    if width <= WLS.WIDEST_NORMAL:
        train_rows = assemble(train.select("paper_id", "label"), feats, width, "paper_id")
        test_rows = assemble(test.select("paper_id", "label"), feats, width, "paper_id")
        pred = fit_predict(make_estimator(regressor), train_rows, test_rows)
    else:  # as Spark would fit it, without a vector of this width on the driver
        feats = stored(feats.select("paper_id", "idx", "value"), "features")
        model = WLS.fit_wide(train.select("paper_id", "label"), feats, "paper_id")
        test_rows = test.select("paper_id", "label")
        pred = model.predict(test_rows, feats.join(test_rows.select("paper_id").distinct(), "paper_id", "left_semi"), "paper_id")
    counts = docs.groupBy().agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "val", 1)).alias("n_val"))
    scores = regression_metrics(pred.select("label", "prediction"))
    n = counts.first()
    return scores.select(F.lit(vectorizer).alias("vectorizer"), F.lit(regressor).alias("regressor"),
                         F.lit(n["n_train"]).cast("bigint").alias("n_train"),
                         F.lit(n["n_val"]).cast("bigint").alias("n_val"),
                         F.col("n").alias("n_test"), "mse", "mae", "r2")


# ---------------------------------------------------------------------------
# set 2: word vectors + dense net / n-gram convolution net, with given weights
# ---------------------------------------------------------------------------

@dataclass
class Net:
    """Weights of a network fitted elsewhere. ``first`` is a function of a
    position giving its (dim, units) weights (dense net) or the ``ConvFilters``
    (convolution net, with ``hidden`` (pooled values, units)); ``bias`` (units),
    ``output`` (units), ``output_bias``."""
    first: object
    bias: list
    output: list
    output_bias: float
    hidden: object = None


def _doubles(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sequences(docs: DataFrame, vectors: DataFrame, dim: int, maxlen: int):
    from quire.operators import embeddings as EM
    from quire.operators import sequences as SQ
    wi = SQ.fit_word_index(docs, "paper_id", "text", order_col="paper_id")
    seqs = SQ.texts_to_sequences(docs, wi, "paper_id", "text")
    kept = stored(seqs.select("paper_id", SQ.truncate_sequences("seq", maxlen).alias("seq")), "sequences")
    return kept, EM.embedding_matrix(wi, vectors, dim)


def _net_scores(docs: DataFrame, h: DataFrame, net: Net):
    from quire.operators import scoring as SC
    pred = h.select("paper_id", SC.output_unit("h", _doubles(net.output), net.output_bias).alias("prediction"))
    pred = docs.select("paper_id", "split", "label").join(pred, "paper_id")
    return regression_metrics(pred.where("split = 'test'")), pred


def run_dense(docs: DataFrame, vectors: DataFrame, net: Net | None = None, dim: int = 300, maxlen: int = 400):
    """Set 2 dense: (metrics on the test papers, predictions of all) of ``docs``
    (``paper_id``, ``split``, ``label``, ``text``) with word ``vectors`` (``word``,
    ``vec``; ``read_named_vectors`` gives them) under the given ``net``."""
    from quire.operators import embeddings as EM
    from quire.operators import scoring as SC
    if net is None:
        raise ValueError("give the net's weights: Spark has no learner for it")
    kept, matrix = _sequences(docs, vectors, dim, maxlen)
    h = SC.position_layer(EM.embed_positions(kept, matrix, "paper_id", dim), kept, "paper_id", net.first,
                          _doubles(net.bias), len(net.bias))
    return _net_scores(docs, h, net)


def run_ncnn(docs: DataFrame, vectors: DataFrame, net: Net | None = None, dim: int = 300, maxlen: int = 400):
    """Set 2 n-gram convolution net; see :func:`run_dense`."""
    from quire.operators import conv as CV
    from quire.operators import scoring as SC
    if net is None:
        raise ValueError("give the net's weights: Spark has no learner for it")
    kept, matrix = _sequences(docs, vectors, dim, maxlen)
    pooled = CV.conv_pool(kept, CV.slot_projections(matrix, net.first), net.first, "paper_id", maxlen)
    cells = pooled.select("paper_id", F.posexplode("pooled").alias("idx", "value"))
    weights = docs.sparkSession.createDataFrame([(i, 1, [float(x) for x in row]) for i, row in enumerate(net.hidden)],
                                                "idx int, df int, w array<double>")
    h = SC.sparse_layer(cells, weights, kept, "paper_id", _doubles(net.bias), len(net.bias))
    return _net_scores(docs, h, net)


# ---------------------------------------------------------------------------
# set 3: per-column TF-IDF + numeric columns, default model and grid search
# ---------------------------------------------------------------------------

def _vect_params(setting: dict) -> "TF.VectorizerParams":
    p = TF.VectorizerParams(ngram_range=tuple(setting.get("ngram_range", (1, 1))),
                            norm=setting.get("norm", "l2"),
                            smooth_idf=setting.get("smooth_idf", True),
                            sublinear_tf=setting.get("sublinear_tf", False), lowercase=False)
    return p.with_stop_words(setting.get("stop_words") is not None)


def _grid_inputs(tok_train: DataFrame, tok_eval: DataFrame, setting: dict):
    """Fit the per-column vectorizers on ``tok_train``; model rows for both."""
    from quire.plans.queries import column_features
    abstract = _vect_params(setting) if setting else TF.VectorizerParams(lowercase=False)
    both = tok_train.unionByName(tok_eval)
    feats, width = column_features(both, F.col("_part") == "fit", {"abstract_t": abstract})
    rows = durable(assemble(both.select("paper_id", "label", "_part"), feats, width, "paper_id"))
    return rows.where("_part = 'fit'"), rows.where("_part = 'eval'"), width


def _dot(x: str, weights) -> F.Column:
    """Intercept and weights times the array column ``x``."""
    w = F.array(*[F.lit(float(v)) for v in weights[1:]])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(weights[0])), lambda a, b: a + b)


SCORE_COLUMNS = "candidate int, fold int, n long, mse double, r2 double"


def _with_vector(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return rows.withColumn("features", array_to_vector("x"))


def _tree_search(folded, model_settings: list[dict], regressor: str) -> list[dict]:
    """Scores of every (vectorizer setting, model setting) and fold; features are
    made once per vectorizer setting and fold, boosted settings share fits."""
    from quire.operators import fold_search as FS
    from quire.operators import search as S
    out = []
    for vi in range(len(folded.settings)):
        for fold in range(folded.k):
            rows = _with_vector(stored(FS.setting_rows(folded, vi, fold), "search-features"))
            train, valid = rows.where((F.col("fold") != fold) & (F.col("fold") < folded.k)), rows.where(F.col("fold") == fold)
            if regressor in S.BOOSTED:
                scored = S.staged_scores(lambda **p: make_estimator(regressor, **p), model_settings, train, valid)
            else:
                scored = []
                for mi, ms in enumerate(model_settings):
                    r = regression_metrics(make_estimator(regressor, **ms).fit(train).transform(valid), digits=None).first()
                    scored.append({"candidate": mi, "n": r["n"], "mse": r["mse"], "r2": r["r2"]})
            out += [r | {"candidate": vi * len(model_settings) + r["candidate"], "fold": fold} for r in scored]
    return out


def run_grid(spark: SparkSession, sf_dir: str | None, regressor: str, n_train: int = 4000,
             n_test: int = 1000, k: int = 4, vect_grid: dict | None = None,
             model_grid: dict | None = None, tokens: DataFrame | None = None, width: int | None = None,
             full_width: bool = False):
    """Set 3: (default metrics, best metrics, scores table, best parameters).

    ``tokens`` are the caller's own tokenised papers (``paper_id``, ``rn``,
    ``label``, the four texts, ``year``, ``n_citation``; see
    ``quire.plans.common.tokenize_papers``); without them the papers view of
    ``sf_dir`` is taken. Rows below ``n_train`` are searched in ``k`` contiguous
    folds, the next ``n_test`` are tested.

    The search sees each text block in ``width`` signed buckets (see
    ``quire.operators.fold_search``): all vectorizer settings come from one
    analysis and one count per fold; least squares is then solved from summed
    products for every setting and fold, and boosted settings that differ in
    their number of trees share a fit. The default and the best model are fitted
    on the same blocks or, for ``lr`` with ``full_width``, on all columns.
    """
    from quire.operators import fold_search as FS
    from quire.operators import search as S
    from quire.operators.splits import fold_of, positional_split
    from quire.plans.common import tokenized
    if regressor not in S.MODEL_GRIDS:
        raise ValueError(f"unknown regressor {regressor!r}; choose one of {sorted(S.MODEL_GRIDS)}")
    if regressor in ("mlp", "svr"):
        raise ValueError(f"no grid search for {regressor!r}: Spark has no such learner")
    vect_settings = S.param_grid(S.VECT_GRID if vect_grid is None else vect_grid)
    model_settings, mapping = S.collapse(S.param_grid(S.MODEL_GRIDS[regressor] if model_grid is None else model_grid), regressor)
    tok = positional_split(tokenized(spark, sf_dir, rn=True) if tokens is None else tokens, "rn", n_train, n_test)
    n = tok.where("part = 'train'").count()
    if n < k:
        raise ValueError(f"cannot make {k} folds of {n} rows")
    tok = tok.withColumn("fold", F.when(F.col("part") == "train", fold_of("rn", n, k)).otherwise(F.lit(k)))
    # the default setting comes first, the grid's after it
    folded = FS.fold_text(tok, [FS.DEFAULT, *vect_settings], k, width or FS.WIDTH)
    m = len(model_settings)
    if regressor == "lr":
        intercepts = [s.get("fit_intercept", True) for s in model_settings]
        scored, weights = FS.least_squares_search(folded, intercepts)
        scored = [r | {"candidate": r["candidate"] - m} for r in scored if r["fold"] < k and r["candidate"] >= m]
    else:
        searched = FS.FoldedText(folded.rows, folded.settings[1:], folded.kinds, folded.weightings, k, folded.width)
        scored = _tree_search(searched, model_settings, regressor)
    scores = spark.createDataFrame([(r["candidate"], r["fold"], r["n"], r["mse"], r["r2"]) for r in scored], SCORE_COLUMNS)
    best = S.best_candidate(S.mean_scores(scores)).first()
    vi, mi = divmod(int(best["candidate"]), m)

    def test_metrics(setting: int, params: dict):
        if regressor == "lr" and full_width:
            train = tok.where("part = 'train'").withColumn("_part", F.lit("fit"))
            test = tok.where("part = 'test'").withColumn("_part", F.lit("eval"))
            tr, te, _ = _grid_inputs(train, test, folded.settings[setting])
            return regression_metrics(make_estimator("lr", **params).fit(tr).transform(te))
        rows = FS.setting_rows(folded, setting, k)
        if regressor == "lr":
            j = intercepts.index(params.get("fit_intercept", True)) if params.get("fit_intercept", True) in intercepts else 0
            pred = rows.where(F.col("fold") == k).withColumn("prediction", _dot("x", weights[setting * m + j]))
            return regression_metrics(pred)
        rows = _with_vector(stored(rows, "search-features"))
        model = make_estimator(regressor, **params).fit(rows.where(F.col("fold") < k))
        return regression_metrics(model.transform(rows.where(F.col("fold") == k)))
    params = {**vect_settings[vi], **model_settings[mi]}
    # candidate numbers of the full product: vectorizer-major, model-minor
    full = [v * m + i for v in range(len(vect_settings)) for i in mapping]
    return test_metrics(0, {}), test_metrics(vi + 1, model_settings[mi]), S.expand(scores, full), params
