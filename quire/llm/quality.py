"""Operator 7: quality classifier.

Statistics of whole texts pass through random Fourier features, which
approximate a Gaussian kernel. Partitions sum the normal equations of a ridge
regression per fold; the sums, whose size depends on the number of features
alone, are solved on the driver. Scores of rows that a fold's solution has not
seen are calibrated by isotonic regression over a fixed grid of scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shingles as S
from quire.llm.common import col, released, small, text_sha, unclear_ids
from quire.operators.least_squares import sum_matrices
from quire.session import ship_package, stored
from quire.sources.papers import load_table

#: Random features, kernel width in standard deviations, ridge per row, grid of scores.
FEATURES, WIDTH, RIDGE, GRID = 128, 4.0, 1e-3, 2000
FOLDS = 4
SEED = 11

STATISTICS = ("bytes", "words", "word_mean", "word_sd", "upper", "digit", "symbol", "shout", "pipe", "stop", "comma",
              "line", "wide", "distinct", "again", "pairs")


def _table(chars) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_SYMBOL, _SHOUT, _PIPE = _table("#$%&*<>[]{}\\^_~`=+@"), _table("!?"), _table("|/")
_STOP, _COMMA, _LINE = _table(".:;"), _table(",'\"()-"), _table("\n")
_WIDE = np.zeros(256, dtype=np.int64)
_WIDE[128:] = 1


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    rows = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    h, row, starts, ends = S.words(data, bounds)
    words = np.bincount(row, minlength=rows).astype(float)
    length = (ends - starts).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    mean = np.bincount(row, weights=length, minlength=rows) / per_word
    square = np.bincount(row, weights=length * length, minlength=rows) / per_word

    def share(table):
        run = np.concatenate(([0], np.cumsum(table[data])))
        return (run[bounds[1:]] - run[bounds[:-1]]) / per_byte
    _, own = S.distinct(h, row)
    same = row[1:] == row[:-1]
    again = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=rows) / per_word
    if len(h) > 1:
        _, pair_row = S.distinct(S.mix(h[1:][same] * np.uint64(3) ^ h[:-1][same]), row[1:][same])
        pairs = np.bincount(pair_row, minlength=rows) / np.maximum(words - 1, 1)
    else:
        pairs = np.zeros(rows)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        *(np.sqrt(share(t)) for t in (_UPPER, _DIGIT, _SYMBOL, _SHOUT, _PIPE, _STOP, _COMMA, _LINE, _WIDE)),
        np.bincount(own, minlength=rows) / per_word, again, pairs], axis=1)


def _statistics(batches):
    for batch in batches:
        data, bounds = S.buffer_of(batch.column(1))
        for lo, hi in S.slices(bounds):
            values = statistics(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *(pa.array(v) for v in values.T),
                 *(c.slice(lo, hi - lo) for c in batch.columns[2:])], ["_id", *STATISTICS, *batch.schema.names[2:]])


class Kernel:
    """Standardised statistics and their random Fourier features."""

    def __init__(self, centre, scale, features: int, width: float, seed: int):
        self.centre, self.scale = np.asarray(centre, float), np.asarray(scale, float)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = rng.standard_normal((len(self.centre), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([f, z / 10, np.ones((len(x), 1))])


def _normal_sums(frames, kernel: Kernel):
    """The partition's sums: one row per fold and row of the equations."""
    sums = {}
    for pdf in frames:
        for fold, part in pdf.groupby("fold"):
            f = kernel(part[list(STATISTICS)].to_numpy())
            both = np.hstack([f, part[["quality"]].to_numpy(dtype=float)])
            sums[fold] = sums.get(fold, 0) + f.T @ both
    for fold, m in sums.items():
        yield pd.DataFrame({"fold": int(fold), "i": np.arange(len(m)), "sums": list(m)})


def _solve(m: np.ndarray, ridge: float) -> np.ndarray:
    a, b = m[:, :-1], m[:, -1]
    rows = max(a[-1, -1], 1.0)  # the last feature is constant
    return np.linalg.solve(a + ridge * rows / len(a) * np.eye(len(a)), b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points in order of ``x``, ``n`` rows each;
    returns the blocks' mean places and values."""
    blocks = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    t = np.array(blocks)
    return t[:, 0] / t[:, 2], t[:, 1] / t[:, 2]


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.round((raw + 0.5) * GRID / 2), 0, GRID).astype(np.int64)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = 0.3, features: int = FEATURES) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``held_out``, ``score``, ``predicted``.

    A row is held out when crc32 of its id as text is a multiple of 5; labels
    are learnt from the others only, all of them. Ids, labels and other columns
    are never inputs of a score, which lies in 0 to 1. Null and empty texts are
    scored as texts without words; a null id counts as the text ''. Rows that
    repeat are scored alike; labels that repeat count each time, null labels
    not at all. Without labelled rows all scores are 0.5. An empty table gives
    an empty result.
    """
    return _scores(df, labels, id_col, text_col, label_col, threshold, features).drop("_sha")


def _scores(df, labels, id_col="doc_id", text_col="text", label_col="quality", threshold=0.3, features=FEATURES,
            sha: Column | None = None) -> DataFrame:
    """:func:`quality_scores` with a column ``_sha`` of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("_text"),
                     (F.lit(None).cast("binary") if sha is None else sha).alias("_sha"))
    kind = docs.schema["_id"].dataType.simpleString()
    remainder = F.pmod(F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    stats = stored(docs.mapInArrow(lambda it: released(_statistics(it)), f"_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS) + ", _sha binary")
                   .withColumn("fold", remainder.cast("int")), "quality-statistics")
    moments = stats.agg(*[f(s) for s in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    centre = [x or 0.0 for x in moments[0::2]]
    scale = [x if x and x > 1e-9 else 1.0 for x in moments[1::2]]
    kernel = Kernel(centre, scale, features, WIDTH, SEED)
    known = stored(stats.where("fold <> 0").join(
        labels.select(col("doc_id").alias("_id"), col(label_col).cast("double").alias("quality"))
        .where("quality is not null"), "_id"), "quality-labelled")

    size = features + len(STATISTICS) + 1
    parts = known.mapInPandas(lambda it: released(_normal_sums(it, kernel)), "fold int, i int, sums array<double>")
    # partitions' sums are added up in the JVM, map-side first
    sums = sum_matrices(parts, ["fold", "i"], "sums").collect()
    per = {k: np.zeros((size, size + 1)) for k in range(1, FOLDS + 1)}
    for r in sums:
        per[r["fold"]][r["i"]] = r["sums"]
    total = sum(per.values())
    weights = _solve(total, RIDGE)
    others = {k: _solve(total - m, RIDGE) for k, m in per.items()}

    def unseen(frames):
        for pdf in frames:
            f = kernel(pdf[list(STATISTICS)].to_numpy())
            raw = np.einsum("ij,ij->i", f, np.array([others[k] for k in pdf["fold"]]).reshape(len(f), size))
            yield pd.DataFrame({"bin": _bin(raw), "quality": pdf["quality"]})
    grid = (known.mapInPandas(lambda it: released(unseen(it)), "bin long, quality double").groupBy("bin")
            .agg(F.avg("quality").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    if grid:
        place, value = isotonic(*(np.array([r[c] for r in grid], dtype=float) for c in ("bin", "y", "n")))
    else:
        place, value = np.zeros(1), np.full(1, 0.5)

    def score(batches):
        for b in batches:
            x = np.stack([b.column(s).to_numpy() for s in STATISTICS], axis=1)
            raw = (kernel(x) @ weights + 0.5) * GRID / 2
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("fold"), pa.array(np.clip(np.interp(raw, place, value), 0, 1)), b.column("_sha")],
                ["_id", "fold", "score", "_sha"])
    out = stats.mapInArrow(lambda it: released(score(it)), f"_id {kind}, fold int, score double, _sha binary")
    return out.select(F.col("_id").alias(id_col), (F.col("fold") == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "_sha")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier does not reject. Where ids repeat
    or are null, rows are told apart by their texts."""
    if not unclear_ids(df, id_col).isEmpty():
        bad = (_scores(df, labels, id_col, text_col, sha=text_sha(text_col)).where("predicted = 0")
               .select(F.col(id_col).alias("_bad"), F.col("_sha").alias("_bad_sha")).distinct())
        same = col(id_col).eqNullSafe(F.col("_bad")) & (text_sha(text_col) == F.col("_bad_sha"))
        return df.join(small(bad, "rejected"), same, "left_anti")
    bad = (quality_scores(df, labels, id_col, text_col).where("predicted = 0")
           .select(F.col(id_col).alias("_bad")).distinct())
    return df.join(small(bad, "rejected"), col(id_col).eqNullSafe(F.col("_bad")), "left_anti")
