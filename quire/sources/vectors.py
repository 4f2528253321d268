"""Word-vector sources.

Text format: ``word v1 ... vd`` separated by white space, one word a line.
GloVe-style files keep the last line of a repeated word; word2vec-style
text files have a short header line (under 20 characters with its newline)
and keep the first. Lines whose tail is not all numbers, blank lines and
lines of the wrong width are dropped and counted, not fatal.

One distributed scan replaces an in-memory dictionary: parse with built-in
expressions, then pick one line per word with ``max_by``/``min_by`` on the
line order (partial aggregation, so a word repeated everywhere still costs
one row per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import WS, strip_ws

FORMATS = {"glove": {"keep": "last", "skip_short": None},
           "w2v": {"keep": "first", "skip_short": 20}}

# vector file by short name
FILES = {"gs": ("glove.6B.300d.txt", "glove"),
         "gb": ("glove.840B.300d.txt", "glove"),
         "w2v": ("GoogleNews-vectors-negative300.txt", "w2v")}


def parse_vector_lines(lines: DataFrame, value_col: str = "value", order_col: str = "line_no",
                       fmt: str = "glove", dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse lines into (word, vec array<float>); returns (vectors, rejects).

    ``rejects`` has (line_no, reason) for blank, non-numeric and wrong-width
    lines (and header lines of word2vec files).
    """
    opts = FORMATS[fmt]
    raw = F.col(value_col)
    parts = F.split(strip_ws(raw), "[" + WS + "]+", -1)
    nums = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                       lambda x: x.try_cast("float"))
    parsed = lines.select(
        F.col(order_col).alias("line_no"),
        F.element_at(parts, 1).alias("word"),
        nums.alias("vec"),
        (F.length(raw) + 1).alias("_len"),
        (F.length(strip_ws(raw)) == 0).alias("_blank"))
    reason = (F.when(F.col("_blank"), "blank")
              .when(F.lit(opts["skip_short"] is not None) &
                    (F.col("_len") < F.lit(opts["skip_short"] or 0)), "header")
              .when(F.exists("vec", lambda x: x.isNull()), "not_numeric")
              .when(F.size("vec") == 0, "no_values"))
    if dim is not None:
        reason = reason.when(F.size("vec") != dim, "wrong_width")
    tagged = parsed.withColumn("reason", reason)
    good = tagged.where(F.col("reason").isNull())
    pick = F.max_by if opts["keep"] == "last" else F.min_by
    vectors = good.groupBy("word").agg(pick("vec", "line_no").alias("vec"))
    rejects = tagged.where(F.col("reason").isNotNull()).select("line_no", "reason")
    return vectors, rejects


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "glove",
                      dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read a text vector file; line order from file, block, position."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_s"))
    lines = lines.withColumn("line_no", F.struct("_f", "_b", "_s"))
    return parse_vector_lines(lines, fmt=fmt, dim=dim)


def read_named_vectors(spark: SparkSession, emb_dir: str, name: str, dim: int = 300):
    """Choose the vector file by short name (gs, gb, w2v)."""
    if name not in FILES:
        raise ValueError(f"unknown embeddings {name!r}; choose one of {sorted(FILES)}")
    fname, fmt = FILES[name]
    return read_word_vectors(spark, f"{emb_dir.rstrip('/')}/{fname}", fmt=fmt, dim=dim)


def vector_lines_from_table(embeddings: DataFrame) -> DataFrame:
    """(``line_no``, ``value``): a text line for every row of the driver's
    ``embeddings``, good and bad by its ``vec_id`` i: word `w` and i div 2, so
    words repeat; a blank line where i % 13 = 5, a short one where i % 23 = 1, a
    word with a blank in it where i % 17 = 7, half of the values where i % 19 = 2
    and a value that is no number where i % 11 = 3."""
    i = F.col("vec_id")
    word = F.concat(F.lit("w"), F.expr("vec_id div 2"))
    values = F.transform("embedding", lambda x: x.cast("string"))
    half = F.expr("slice(embedding, 1, size(embedding) div 2)")
    line = (F.when(i % 13 == 5, F.lit("  "))
            .when(i % 23 == 1, F.concat(word, F.lit(" 0.5")))
            .when(i % 17 == 7, F.concat(word, F.lit(" b "), F.array_join(values, " ")))
            .when(i % 19 == 2, F.concat(word, F.lit(" "), F.array_join(F.transform(half, lambda x: x.cast("string")), " ")))
            .when(i % 11 == 3, F.concat(word, F.lit(" "), F.array_join(values, " "), F.lit("x")))
            .otherwise(F.concat(word, F.lit(" "), F.array_join(values, "  "))))
    return embeddings.select(i.alias("line_no"), F.coalesce(line, word).alias("value"))


def word_lines_from_table(embeddings: DataFrame, word_index: DataFrame) -> DataFrame:
    """(``line_no``, ``value``): lines ``word v1 ... vd``; word index i takes the
    vector with ``vec_id`` = i."""
    met = embeddings.join(word_index.select("term", "idx"), F.col("vec_id") == F.col("idx"))
    values = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    return met.select(F.col("vec_id").alias("line_no"), F.concat_ws(" ", "term", values).alias("value"))
