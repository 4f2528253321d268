"""Operator 13: language identification with language-bitmask n-gram filters.

Training: the n-grams (1 to 3 letters, words padded by a blank) of all labelled
texts are counted by language, exactly (three code points fit into a long). A
language contains an n-gram if it makes up at least ``MIN_RATE`` of the language's
n-grams of its length, and at least ``MIN_SHARE`` of the rate it has in the
language where it is most usual. Rates make the model's size bounded whatever
the corpus: at most 3 / MIN_RATE n-grams a language.

The filter is a bit-sliced Bloom filter: a row of language bits for every place.
An n-gram's languages are the AND of its places' rows: one lookup answers for all
languages. A text's distinct n-grams are looked up, each language's hits are
counted from the masks and corrected for its own rate of false positives, which
follows from how full its slice is; the language with the most hits decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col
from quire.session import ship_package, stored
from quire.sources.papers import load_table

MIN_RATE = 2e-5
MIN_SHARE = 0.25
#: Places of the filter per n-gram of the largest language, and rows per lookup.
PLACES_PER_GRAM, HASHES = 8, 4
#: Characters that are handled at a time; a longer text in several pieces.
PIECE = 1 << 17
#: Distinct (language, n-gram) counts that a task holds before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BITS, _LOW = 21, (1 << 21) - 1


def grams(text: str) -> np.ndarray:
    """The packed n-grams of ``text``, in lower case, every run of other
    characters than letters one blank, blanks at both ends. Blanks alone and
    n-grams over two words are none."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    one = c[c != 32]
    two = c[:-1] | c[1:] << _BITS
    three = c[:-2] | c[1:-1] << _BITS | c[2:] << 2 * _BITS
    return np.concatenate([one, two, three[c[1:-1] != 32]])


def pieces(text: str, size: int = PIECE):
    """``text`` in parts of about ``size`` characters, cut after a blank where
    there is one; only n-grams at a cut without blank differ."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            cut = text.rfind(" ", lo, hi)
            hi = cut + 1 if cut > lo else hi
        yield text[lo:hi]
        lo = hi


def _counts(batches):
    """(``lang``, ``gram``, ``n``), summed over the task as far as ``HELD`` goes."""
    held: dict[str, list] = {}
    size = 0

    def hand_on():
        for lang, parts in held.items():
            keys, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                             ["lang", "gram", "n"])
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            for piece in pieces(text):
                keys, n = np.unique(grams(piece), return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
            if size > HELD:
                held = {k: [_sum(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from hand_on()
                    held, size = {}, 0
    yield from hand_on()


def _sum(parts):
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_rate: float = MIN_RATE,
          min_share: float = MIN_SHARE) -> DataFrame:
    """(``lang``, ``gram``): the n-grams of every language of ``df``; rows
    without text or language teach nothing."""
    ship_package(df.sparkSession)
    known = df.select(col(lang_col).alias("lang"), col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = stored(known.mapInArrow(_counts, "lang string, gram long, n long")
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    length = F.when(F.col("gram") < 1 << _BITS, 1).when(F.col("gram") < 1 << 2 * _BITS, 2).otherwise(3)
    sized = counts.withColumn("length", length)
    whole = sized.groupBy("lang", "length").agg(F.sum("n").alias("whole")) \
        .select(F.col("lang").alias("_lang"), F.col("length").alias("_length"), "whole")
    rates = sized.join(whole, (F.col("lang") == F.col("_lang")) & (F.col("length") == F.col("_length"))) \
        .select("lang", "gram", (F.col("n") / F.col("whole")).alias("rate")).where(F.col("rate") >= min_rate)
    best = rates.groupBy(F.col("gram").alias("_gram")).agg(F.max("rate").alias("best"))
    kept = rates.join(best, F.col("gram") == F.col("_gram")).where(F.col("rate") >= min_share * F.col("best"))
    return stored(kept.select("lang", "gram"), "language-grams")


class LanguageFilter:
    """A bit-sliced Bloom filter: ``rows[place]`` has a bit for each language."""

    def __init__(self, langs: list[str], rows: np.ndarray, usual: int):
        self.langs, self.rows, self.usual = langs, rows, usual
        fill = np.array([self._bit(rows, k).mean() if len(rows) else 0.0 for k in range(len(langs))])
        self.false = fill ** HASHES

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        """``HASHES`` places (a row each) of every key, by double hashing; ``size``
        is a power of two."""
        x = keys.astype(np.uint64)
        with np.errstate(over="ignore"):
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            step = (x >> np.uint64(32)) | np.uint64(1)
            return np.stack([(x + np.uint64(i) * step) & np.uint64(size - 1) for i in range(HASHES)]).astype(np.int64)

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    @classmethod
    def fit(cls, model: DataFrame, langs: list[str], largest: int, usual: int) -> LanguageFilter:
        """The filter of (``lang``, ``gram``) rows. Its places are set by Spark;
        only its rows, bounded by the model's size, reach the driver."""
        size = 1 << max(10, (PLACES_PER_GRAM * largest - 1).bit_length())
        words = -(-len(langs) // 64)
        rows = np.zeros((size, words), np.uint64)
        number = {x: i for i, x in enumerate(langs)}

        def bits(batches):
            for b in batches:
                k = np.array([number[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
                at = cls.places(b.column("gram").to_numpy(zero_copy_only=False), size).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.tile(k // 64, HASHES)),
                     pa.array((np.uint64(1) << np.tile(k % 64, HASHES).astype(np.uint64)).view(np.int64))], ["place", "word", "bit"])
        set_ = model.mapInArrow(bits, "place long, word long, bit long").groupBy("place", "word").agg(F.bit_or("bit").alias("mask"))
        got = set_.toArrow()
        rows[got.column("place").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        return cls(langs, rows, usual)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """For each language, in how many of ``keys`` its bit stands."""
        if not len(keys):
            return np.zeros(len(self.langs))
        at = self.places(keys, len(self.rows))
        masks = self.rows[at[0]]
        for places in at[1:]:
            masks &= self.rows[places]
        return np.array([int(self._bit(masks, k).sum()) for k in range(len(self.langs))], dtype=float)

    def decide(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        keys = np.unique(grams(text)) if len(text) <= PIECE else _union(map(grams, pieces(text)))
        # of n lookups, hits = true + (n - true) * false positives
        true = np.clip((self.hits(keys) - len(keys) * self.false) / (1 - np.minimum(self.false, 0.999)), 0, len(keys))
        best = int(true.argmax()) if true.any() else self.usual
        return self.langs[best], float(true[best] / true.sum()) if true.any() else 0.0


def _union(parts) -> np.ndarray:
    out = np.zeros(0, np.int64)
    for p in parts:
        out = np.union1d(out, p)
    return out


def fit_filter(train: DataFrame, text_col: str = "text", lang_col: str = "lang", min_rate: float = MIN_RATE,
               min_share: float = MIN_SHARE) -> LanguageFilter:
    """The filter learned from all labelled rows of ``train``. Languages are in
    code-point order, so the smallest wins a tie; where a text holds none of
    their n-grams, the language of most rows is taken."""
    model = learn(train, text_col, lang_col, min_rate, min_share)
    sizes = {r["lang"]: r["n"] for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = {r[0]: r[1] for r in train.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
            .groupBy(col(lang_col)).count().collect()}
    langs = sorted(sizes, key=lambda x: x.encode())
    usual = max(range(len(langs)), key=lambda i: docs[langs[i]], default=0)
    return LanguageFilter.fit(model, langs, max(sizes.values(), default=0), usual)


def predict_languages(df: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text",
                      keep: list[str] = []) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` for every row of ``df`` (and its
    columns ``keep``)."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    docs = df.select(col(id_col).alias("_id"), col(text_col).alias("_text"), *[col(c) for c in keep])

    def run(batches):
        filter_ = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [filter_.decide(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *[part.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()),
                     pa.array([x for _, x in found], pa.float64())], ["_id", *keep, "lang_pred", "score"])
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ["_id", *keep]) + ", lang_pred string, score double"
    return docs.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``held_out``, ``lang_pred``, ``score``.

    Learned from rows with text and language whose crc32(id as text) mod 4 is
    not 2; a null id counts as the empty text. ``score`` is the best language's
    part of all languages' corrected hits; ties go to the smallest language in
    code-point order. A null text, or one without a letter, is `und` with score
    0, and so is every text if nothing was learned; a text of which no n-gram is
    known gets the language of most training rows, score 0. Repeated rows get
    the same answer twice; texts are read whole, long ones in pieces; an empty
    table gives an empty result; other columns are ignored.
    """
    remainder = F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 4
    rows = df.select(col(id_col).alias(id_col), col(text_col).alias("text"), col(lang_col).alias("lang"),
                     (remainder == 2).alias("held_out"))
    model = fit_filter(rows.where("not held_out"))
    out = predict_languages(rows, model, id_col, "text", ["held_out"])
    return out.select(col(id_col), "held_out", "lang_pred", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(load_table(spark, sf_dir, "documents"))
