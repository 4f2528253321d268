"""G2 over vectorizer settings by fold subtraction.

A plain search refits every column's vocabulary for every setting and fold.
Here a text is analysed once per (n-gram range, stop words), six times for the
whole grid, and each analysis is counted once: document frequencies and row
counts per fold. What the complement of a fold knows of a term is the total
minus that fold's count, and a term it has not seen has weight 0. Idf, sub-linear
counts and norms are then functions of these numbers: the base weights (count
kind x idf kind x held-out part) are summed per paper, and a row's l1 and l2
norms with them, so all 72 settings come from one aggregation.

Each block's terms are added up with signs into ``width`` buckets (the rule of
F12), which bounds a row: settings can then be fitted by summed products (see
``least_squares``) or by trees.

The part number ``k`` (after the folds 0 to k-1) holds the test rows, whose
texts are never counted: its complement is the whole train part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.analyzers import ENGLISH_STOP_WORDS, analyze, remove_stop_words, word_ngrams
from quire.operators import least_squares as LS
from quire.operators.hashing import signed_hash
from quire.operators.hot_join import hot_join
from quire.operators.rows import deal_by
from quire.operators.tfidf import VOCABULARY_ROW_BYTES
from quire.session import ship_package, stored

WIDTH = 8
TEXTS = ("kw", "title_t", "abstract_t", "venue")
NUMBERS = ("year", "n_citation")
SEARCHED = 2  # the abstract's place among the texts
DEFAULT = {"ngram_range": (1, 1), "norm": "l2", "smooth_idf": True, "stop_words": None, "sublinear_tf": False}


def _kind(setting: dict) -> tuple:
    return tuple(setting["ngram_range"]), setting["stop_words"] is not None


def _weighting(setting: dict) -> tuple:
    return bool(setting["sublinear_tf"]), bool(setting["smooth_idf"])


@dataclass
class FoldedText:
    """``rows``: (paper_id, fold, label, numbers, ``sums``, ``l1``, ``l2``), a row
    per paper; ``sums`` has a number per (block, bucket, weighting, held-out
    part), the norms per (block, weighting, held-out part)."""
    rows: DataFrame
    settings: list[dict]
    kinds: list[tuple]
    weightings: list[tuple]
    k: int
    width: int

    @property
    def n_features(self) -> int:
        return len(TEXTS) * self.width + len(NUMBERS)

    def block(self, setting: dict) -> int:
        return len(TEXTS) - 1 + self.kinds.index(_kind(setting))


def _terms(tok: DataFrame, kinds: list[tuple]) -> DataFrame:
    """(``paper_id``, ``fold``, ``block``, ``term``): the texts that have one
    setting, then the searched text's analyses. Words are split once and
    written; n-grams are made from the written words."""
    searched = TEXTS[SEARCHED]
    words = {f"w{i}": analyze(c, False) for i, c in enumerate(TEXTS)}
    if any(stop for _, stop in kinds):
        words["stopped"] = remove_stop_words(analyze(searched, False), ENGLISH_STOP_WORDS)
    split = stored(tok.select("paper_id", "fold", *[w.alias(n) for n, w in words.items()]), "search-words")
    # Papers' words are dealt out by id once: counting a paper's terms needs no
    # further shuffle of terms.
    split = deal_by(split, "paper_id")
    blocks = [F.col(f"w{i}") for i in range(len(TEXTS)) if i != SEARCHED] + \
        [word_ngrams(F.col("stopped" if stop else f"w{SEARCHED}"), *n) for n, stop in kinds]
    return split.select("paper_id", "fold", F.posexplode(F.array(*blocks)).alias("block", "terms")) \
        .select("paper_id", "fold", "block", F.explode("terms").alias("term"))


def fold_frequencies(tf: DataFrame, k: int) -> DataFrame:
    """(``block``, ``term``, ``df0`` ...): the papers of each fold that hold a term."""
    return tf.where(F.col("fold") < k).groupBy("block", "term").agg(
        *[F.count_if(F.col("fold") == f).alias(f"df{f}") for f in range(k)])


def pair_of(f: int, k: int):
    """The frequencies of folds ``f`` and ``f`` + 1 as one number."""
    return F.col(f"df{f}") if f + 1 == k else F.col(f"df{f}").bitwiseOR(F.shiftleft(F.col(f"df{f + 1}"), 32))


def _paper_sums(info: dict, weightings: list[tuple], rest: list[int]):
    """A mapInArrow function over counted terms, sorted by paper: each paper's
    sums and norms. A batch's last paper waits for the next batch."""
    blocks, width, k, base = info["blocks"], info["width"], info["k"], info["base"]

    def sums(t: dict):
        papers, at = np.unique(t["paper_id"], return_inverse=True)
        dfs = np.stack([t[f"d{f // 2}"] >> (32 * (f % 2)) & 0xFFFFFFFF for f in range(k)], axis=1).astype(float)
        sign, tf_ = np.sign(t["tf"]).astype(float), np.abs(t["tf"])
        left = dfs.sum(axis=1, keepdims=True) - np.concatenate([dfs, np.zeros((len(dfs), 1))], axis=1)
        n = np.array(rest, dtype=float)
        with np.errstate(divide="ignore"):
            idf = {True: np.log((n + 1) / (left + 1)) + 1, False: np.log(n / left) + 1}
        cell = at * (blocks * width) + t["cell"]
        row = cell // width
        out = np.zeros((len(papers) * blocks * width, base))
        l1, l2 = np.zeros((len(papers) * blocks, base)), np.zeros((len(papers) * blocks, base))
        for j, (sublinear, smooth) in enumerate(weightings):
            tf = np.log(tf_) + 1 if sublinear else tf_.astype(float)
            for h in range(k + 1):
                v = tf * np.where(left[:, h] > 0, idf[smooth][:, h], 0.0)
                c = j * (k + 1) + h
                out[:, c] = np.bincount(cell, v * sign, len(out))
                l1[:, c] = np.bincount(row, v, len(l1))
                l2[:, c] = np.sqrt(np.bincount(row, v * v, len(l2)))
        cols = [pa.array(papers)] + [pa.array(list(x.reshape(len(papers), -1)), pa.list_(pa.float64())) for x in (out, l1, l2)]
        return pa.RecordBatch.from_arrays(cols, ["paper_id", "sums", "l1", "l2"])

    def run(batches):
        held = None
        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            cut = int(np.searchsorted(t["paper_id"], t["paper_id"][-1])) if len(t["paper_id"]) else 0
            if cut:
                yield sums({c: x[:cut] for c, x in t.items()})
            held = {c: x[cut:] for c, x in t.items()}
        if held is not None and len(held["paper_id"]):
            yield sums(held)
    return run


def fold_text(tok: DataFrame, settings: list[dict], k: int = 4, width: int = WIDTH) -> FoldedText:
    """Analyse and count ``tok`` (paper_id, fold, label, texts, numbers) for all
    ``settings``; ``fold`` is 0 to k-1, or k for test rows."""
    ship_package(tok.sparkSession)
    settings = [DEFAULT | s for s in settings]
    kinds = list(dict.fromkeys(_kind(s) for s in [DEFAULT, *settings]))
    weightings = list(dict.fromkeys(_weighting(s) for s in [DEFAULT, *settings]))
    tf = stored(_terms(tok, kinds).groupBy("paper_id", "fold", "block", "term").agg(F.count(F.lit(1)).alias("tf")), "search-terms")
    sizes = {r["fold"]: r["n"] for r in tok.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train = sum(n for f, n in sizes.items() if f < k)
    h = signed_hash("term")
    # A cell is moved twice, so its numbers are packed: two folds' frequencies in one
    # number, the sign with the bucket, then with the count.
    bucket = (F.abs(h) % F.lit(width)).cast("int") + 1
    known = stored(fold_frequencies(tf, k).select(
        "block", "term", sum(F.col(f"df{f}") for f in range(k)).alias("df"), F.when(h >= 0, bucket).otherwise(-bucket).alias("bucket"),
        *[pair_of(f, k).alias(f"d{f // 2}") for f in range(0, k, 2)]), "search-frequencies")
    # Terms that no train paper holds have no weight in any part.
    # Frequent ones meet their numbers where they lie.
    met = hot_join(tf.drop("fold"), known, ["block", "term"], "df", VOCABULARY_ROW_BYTES + 8 * k, "paper_id")
    cells = met.select("paper_id", (F.col("block") * F.lit(width) + F.abs("bucket") - 1).alias("cell"),
                       F.when(F.col("bucket") > 0, F.col("tf")).otherwise(-F.col("tf")).alias("tf"), *[f"d{i}" for i in range((k + 1) // 2)])
    cells = deal_by(cells, "paper_id", like=tf).sortWithinPartitions("paper_id")
    folded = FoldedText(tok, settings, kinds, weightings, k, width)
    info, _ = _plain(folded)
    run = _paper_sums(info, weightings, [n_train - sizes.get(f, 0) for f in range(k)] + [n_train])
    kind = tok.schema["paper_id"].dataType.simpleString()
    packed = cells.mapInArrow(run, f"paper_id {kind}, sums array<double>, l1 array<double>, l2 array<double>")
    rows = tok.select("paper_id", "fold", F.col("label").cast("double").alias("label"),
                      F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMBERS]).alias("numbers"))
    folded.rows = stored(rows.join(packed, "paper_id", "left"), "search-rows")
    return folded


class _Batch:
    """The rows of a record batch as arrays: sums (paper, block, bucket, base
    weight) and norms (paper, block, base weight)."""

    def __init__(self, batch: pa.RecordBatch, info: dict):
        n, shape = batch.num_rows, (info["blocks"], info["width"], info["base"])

        def full(name, *shape):
            column = batch.column(name)
            out = np.zeros((n, *shape))  # papers without a known term have no sums
            out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, *shape)
            return out
        self.sums = full("sums", *shape)
        self.l1, self.l2 = full("l1", shape[0], shape[2]), full("l2", shape[0], shape[2])
        self.numbers = batch.column("numbers").flatten().to_numpy().reshape(n, -1)
        self.label = batch.column("label").to_numpy()
        self.fold = batch.column("fold").to_numpy()
        self.info = info

    def text(self, block: int, weighting: int, held: int, norm) -> np.ndarray:
        at = weighting * (self.info["k"] + 1) + held
        x = self.sums[:, block, :, at]
        if norm is None:
            return x
        size = (self.l1 if norm == "l1" else self.l2)[:, block, at]
        return x / np.where(size > 0, size, 1.0)[:, None]

    def features(self, setting: tuple, held: int) -> np.ndarray:
        block, weighting, norm = setting
        fixed = iter(range(len(TEXTS) - 1))
        parts = [self.text(block, weighting, held, norm) if i == SEARCHED
                 else self.text(next(fixed), self.info["plain"], held, "l2") for i in range(len(TEXTS))]
        return np.concatenate([*parts, self.numbers], axis=1)


def _plain(folded: FoldedText) -> tuple[dict, list[tuple]]:
    """What tasks need to know."""
    info = {"blocks": len(TEXTS) - 1 + len(folded.kinds), "width": folded.width, "k": folded.k,
            "base": len(folded.weightings) * (folded.k + 1), "plain": folded.weightings.index(_weighting(DEFAULT))}
    return info, [(folded.block(s), folded.weightings.index(_weighting(s)), s["norm"]) for s in folded.settings]


def search_matrices(folded: FoldedText, slice_rows: int = 512) -> DataFrame:
    """(``setting``, ``held``, ``out``, ``gram``): the summed products of every
    setting's rows, for each held-out part apart from the rest."""
    info, settings = _plain(folded)
    size = folded.n_features + 2

    def run(batches):
        total = np.zeros((len(settings), info["k"] + 1, 2, size, size))
        for b in batches:
            for lo in range(0, b.num_rows, slice_rows):
                x = _Batch(b.slice(lo, slice_rows), info)
                one = np.ones((len(x.label), 1))
                for i, s in enumerate(settings):
                    for h in range(info["k"] + 1):
                        z = np.concatenate([one, x.features(s, h), x.label[:, None]], axis=1)
                        for out, some in enumerate((z[(x.fold != h) & (x.fold < info["k"])], z[x.fold == h])):
                            total[i, h, out] += some.T @ some
        for i in range(len(settings)):
            packed = LS.pack(total[i]).reshape(-1, size * (size + 1) // 2)
            held, out = np.divmod(np.arange(len(packed)), 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packed), i, np.int32)), pa.array(held.astype(np.int32)), pa.array(out.astype(np.int32)),
                 pa.array(list(packed), pa.list_(pa.float64()))], ["setting", "held", "out", "gram"])
    parts = folded.rows.mapInArrow(run, "setting int, held int, out int, gram array<double>")
    return LS.sum_matrices(parts, ["setting", "held", "out"])


def least_squares_search(folded: FoldedText, intercepts=(True, False)) -> tuple[list[dict], dict]:
    """Scores of every (setting, intercept) and part, and the weights of each
    fitted on the whole train part. Candidates count settings first, then
    intercepts; part k holds the test rows."""
    size = folded.n_features + 2
    grams = {(r["setting"], r["held"], r["out"]): LS.unpack(r["gram"], size) for r in search_matrices(folded).collect()}
    scored, weights = [], {}
    for i in range(len(folded.settings)):
        for j, intercept in enumerate(intercepts):
            candidate = i * len(intercepts) + j
            for h in range(folded.k + 1):
                w = LS.solve(grams[i, h, 0], intercept)
                scored.append({"candidate": candidate, "fold": h, **LS.scores(grams[i, h, 1], w)})
            weights[candidate] = w
    return scored, weights


def setting_rows(folded: FoldedText, setting: int, held: int) -> DataFrame:
    """(``paper_id``, ``fold``, ``label``, ``x``): every paper's features under one
    setting, as known to the complement of ``held``."""
    info, settings = _plain(folded)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = _Batch(part, info).features(settings[setting], held)
                yield pa.RecordBatch.from_arrays(
                    [part.column("paper_id"), part.column("fold"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))],
                    ["paper_id", "fold", "label", "x"])
    return folded.rows.mapInArrow(run, "paper_id long, fold int, label double, x array<double>")
