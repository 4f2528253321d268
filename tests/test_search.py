"""The two-level search against plain searches that refit everything."""
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quire.functions.analyzers import ENGLISH_STOP_WORDS
from quire.operators import fold_search as FS
from quire.operators import least_squares as LS
from quire.operators import models as MD
from quire.operators import search as S
from quire.plans.runs import run_default, run_grid

N_TRAIN, N_TEST, K = 31, 9, 4


def papers():
    draw = random.Random(3)
    words = ["the", "of", "model", "data", "graph", "mesh", "plan", "x1", "rare"]
    rows = []
    for i in range(N_TRAIN + N_TEST + 3):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(0, 14)))
        rows.append((100 + i, i, float(draw.randint(1, 9) + len(text) // 9), draw.choice(["key , mesh", "data", ""]),
                     draw.choice(["A plan", "model", "the graph"]), text + f" only{i % 7}", draw.choice(["v1", "v2", "v9"]),
                     1990 + draw.randint(0, 20), draw.randint(0, 40)))
    return rows


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(papers(), "paper_id long, rn long, label double, kw string, title_t string, abstract_t string, "
                                           "venue string, year int, n_citation int")


def hashed(term):
    import hashlib
    u = int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big")
    return u - (1 << 32) if u >= 1 << 31 else u


def plain_block(train, rows, setting, width):
    """Fit a vocabulary on ``train``, weigh ``rows``, add up with signs."""
    stop = set(ENGLISH_STOP_WORDS) if setting["stop_words"] else set()

    def terms(text):
        w = [t for t in re.findall(r"\w\w+", text) if t not in stop]
        lo, hi = setting["ngram_range"]
        return Counter(" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1))
    df = Counter(t for text in train for t in terms(text))
    n, out = len(train), np.zeros((len(rows), width))
    for r, text in enumerate(rows):
        value = {}
        for t, c in terms(text).items():
            if df[t]:
                idf = math.log((n + 1) / (df[t] + 1)) if setting["smooth_idf"] else math.log(n / df[t])
                value[t] = ((math.log(c) + 1) if setting["sublinear_tf"] else c) * (idf + 1)
        size = {"l1": sum(value.values()), "l2": math.sqrt(sum(v * v for v in value.values())), None: 1}[setting["norm"]]
        for t, v in value.items():
            out[r, abs(hashed(t)) % width] += math.copysign(v / size, hashed(t) or 1)
    return out


def plain_features(rows, train, setting, width):
    parts = [plain_block([r[c] for r in train], [r[c] for r in rows], setting if c == 5 else FS.DEFAULT, width) for c in (3, 4, 5, 6)]
    return np.concatenate([*parts, np.array([[r[7], r[8]] for r in rows], float)], axis=1)


def plain_score(train, valid, setting, intercept, width):
    x, y = plain_features(train, train, setting, width), np.array([r[2] for r in train])
    z, t = plain_features(valid, train, setting, width), np.array([r[2] for r in valid])
    if intercept:
        x, z = (np.c_[np.ones(len(a)), a] for a in (x, z))
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - ((t - z @ w) ** 2).sum() / ((t - t.mean()) ** 2).sum()


def folds(n, k):
    sizes = [n // k + (i < n % k) for i in range(k)]
    return list(itertools.chain.from_iterable([i] * s for i, s in enumerate(sizes)))


def test_all_72_settings_equal_a_plain_search(spark, tokens):
    default, best, scores, params = run_grid(spark, None, "lr", N_TRAIN, N_TEST, K, tokens=tokens, width=1)
    got = {(r.candidate, r.fold): r.r2 for r in scores.collect()}
    rows, at = papers(), folds(N_TRAIN, K)
    train, test = rows[:N_TRAIN], rows[N_TRAIN:N_TRAIN + N_TEST]
    candidates = [(v, m) for v in S.param_grid(S.VECT_GRID) for m in S.param_grid(S.MODEL_GRIDS["lr"])]
    assert len(candidates) == 576 and len(got) == 576 * K
    plain, known = [], {}
    for i, (v, m) in enumerate(candidates):
        for f in range(K):
            key = (repr(v), m["fit_intercept"], f)
            if key not in known:
                known[key] = plain_score([r for r, a in zip(train, at) if a != f], [r for r, a in zip(train, at) if a == f],
                                         v, m["fit_intercept"], 1)
            assert got[i, f] == pytest.approx(known[key], abs=1e-6), (i, f)
        plain.append(np.mean([known[repr(v), m["fit_intercept"], f] for f in range(K)]))
    v, m = candidates[int(np.argmax(plain))]
    assert {k: params[k] for k in v} == v and params["fit_intercept"] == m["fit_intercept"]
    assert default.first().r2 == pytest.approx(plain_score(train, test, FS.DEFAULT, True, 1), abs=1e-4)
    assert best.first().r2 == pytest.approx(plain_score(train, test, v, m["fit_intercept"], 1), abs=1e-4)
    assert best.first().n == N_TEST


def test_search_of_trees_on_given_papers(spark, tokens):
    default, best, scores, params = run_grid(
        spark, None, "gb", N_TRAIN, N_TEST, 2, tokens=tokens, width=2, vect_grid={"norm": ["l2", None]},
        model_grid={"n_estimators": [2, 3], "max_depth": [1, 2]})
    assert scores.count() == 2 * 4 * 2
    assert set(params) == {"norm", "n_estimators", "max_depth"}
    assert default.first().n == best.first().n == N_TEST


def test_prefixes_of_a_boosted_model_equal_separate_fits(spark):
    draw = random.Random(5)
    rows = [(float(draw.randint(0, 9)), [draw.random(), float(draw.randint(0, 3)), draw.random()]) for _ in range(120)]
    df = spark.createDataFrame(rows, "label double, x array<double>").withColumn("features", array_to_vector("x")).cache()
    train, valid = df.where("x[0] < 0.7"), df.where("x[0] >= 0.7")
    settings = S.param_grid({"n_estimators": [1, 3, 6], "max_depth": [1, 3], "max_features": ["auto", "sqrt"]})
    fits = []

    def make(**p):
        fits.append(p)
        return MD.gradient_boosting(**p)
    got = S.staged_scores(make, settings, train, valid)
    assert len(fits) == 4 and all(p["n_estimators"] == 6 for p in fits)
    for r, s in zip(got, settings):
        alone = MD.gradient_boosting(**s).fit(train).transform(valid)
        mse, spread = alone.agg(F.avg(F.expr("pow(label - prediction, 2)")), F.var_pop("label")).first()
        assert r["mse"] == pytest.approx(mse, abs=1e-9) and r["r2"] == pytest.approx(1 - mse / spread, abs=1e-9)


def test_least_squares_over_folds_equals_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 3)) * [1, 30, 0.1] + [0, 2000, 0]
    x = np.c_[x, x[:, 0] * 2]  # depends on the first
    y = x @ [1, 0.2, 3, 0] + draw.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))],
                               "a double, b double, c double, d double, label double, fold int")
    got = {(r["candidate"], r["fold"]): r for r in LS.cross_validate_least_squares(df, ["a", "b", "c", "d"])}
    at = np.arange(60) % 3
    for c, intercept in enumerate((True, False)):
        z = np.c_[np.ones(60), x] if intercept else x
        for f in range(3):
            w = np.linalg.lstsq(z[at != f], y[at != f], rcond=None)[0]
            e = y[at == f] - z[at == f] @ w
            assert got[c, f]["r2"] == pytest.approx(1 - (e @ e) / ((y[at == f] - y[at == f].mean()) ** 2).sum(), abs=1e-7)
            assert got[c, f]["mse"] == pytest.approx((e @ e) / 20, abs=1e-7) and got[c, f]["n"] == 20


@pytest.mark.parametrize("vectorizer", ["tfidf", "count", "hash", "union"])
def test_set_1_equals_numpy_where_the_solution_is_unique(spark, vectorizer):
    draw = random.Random(11)
    words = ["graph", "plan", "mesh", "data", "model"]
    rows = [(i, "train" if i < 60 else "test", " ".join(draw.choice(words) for _ in range(draw.randint(1, 9)))) for i in range(80)]
    rows = [(i, s, 3.0 + 2 * t.count("graph") - t.count("mesh") + draw.random(), t) for i, s, t in rows]
    docs = spark.createDataFrame(rows, "paper_id long, split string, label double, text string")
    got = run_default(spark, None, vectorizer, docs=docs).first()
    counts = np.array([[t.split().count(w) for w in words] for *_, t in rows], float)
    train = np.array([s == "train" for _, s, *_ in rows])
    df = (counts[train] > 0).sum(axis=0)
    weighed = counts * (np.log(61 / (df + 1)) + 1)
    signs = np.array([1.0 if hashed(w) >= 0 else -1.0 for w in words])
    blocks = {"tfidf": weighed / np.linalg.norm(weighed, axis=1, keepdims=True), "count": counts,
              "hash": counts * signs / np.linalg.norm(counts, axis=1, keepdims=True)}
    x = np.hstack([np.ones((80, 1)), *(blocks.values() if vectorizer == "union" else [blocks[vectorizer]])])
    y = np.array([r[2] for r in rows])
    w = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
    e = y[~train] - x[~train] @ w
    assert (got.n_train, got.n_val, got.n_test) == (60, 0, 20)
    assert got.mse == pytest.approx((e @ e) / 20, abs=0.02) and got.mae == pytest.approx(np.abs(e).mean(), abs=0.02)


def test_unknown_choices(spark):
    with pytest.raises(ValueError):
        run_grid(spark, None, "knn")
    with pytest.raises(ValueError):
        run_grid(spark, None, "svr")
    with pytest.raises(ValueError):
        run_default(spark, "", regressor="ridge")
    with pytest.raises(ValueError):
        run_default(spark, "", vectorizer="bm25")
