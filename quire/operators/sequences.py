"""Index sequences.

F14 word index: words counted over the texts, ordered by descending count,
ties by first appearance (document order, then position), numbered from 1;
0 is padding. F15 maps each text to the indices of its known words in text
order. F16 keeps the last ``maxlen`` indices of longer sequences and pads
shorter ones with 0 at the end.

Numbering uses the range-partitioned row index, never a single-task window;
a text stays one row, to which the indices of its rarer words are brought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.analyzers import sequence_words
from quire.operators.by_document import fill_in, first_and_count, look_up
from quire.operators.hot_join import BUDGET
from quire.operators.rows import with_row_index
from quire.session import stored


#: What a term and its index take in a broadcast.
INDEX_ROW_BYTES = 96


def fit_word_index(df: DataFrame, id_col: str, text_col: str,
                   order_col: str | None = None) -> DataFrame:
    """(term, idx, cnt) with idx starting at 1."""
    order_col = order_col or id_col
    # Words are counted over a few texts where these lie; texts are not moved, and
    # one row is left per such piece and term. Numbers alone are summed (a least
    # struct would sort every word of the corpus).
    words = df.select(F.col(order_col).alias("o"), sequence_words(text_col).alias("_words"))
    agg = first_and_count(words, "o").groupBy("term").agg(
        F.sum("n").alias("cnt"), F.min("o").alias("first_doc"), F.min_by("p", "o").alias("first_pos"))
    ranked = with_row_index(agg, [F.desc("cnt"), F.asc("first_doc"), F.asc("first_pos")], name="idx", columnar=True)
    # written as Parquet, so its size in bytes decides how it is joined
    return stored(ranked.select("term", (F.col("idx") + 1).alias("idx"), "cnt"), "word-index")


def texts_to_sequences(df: DataFrame, word_index: DataFrame, id_col: str,
                       text_col: str, budget: int = BUDGET) -> DataFrame:
    """(id, seq array<int>) -- every document kept, unknown words dropped.

    The most frequent words, as many as fit into ``budget`` bytes, are looked up
    where the text lies, which stays one row; places of rarer words alone are
    shuffled to meet their index and brought back to their text.
    """
    words = df.select(F.monotonically_increasing_id().alias("_row"), id_col, sequence_words(text_col).alias("_words"))
    most = max(1, budget // INDEX_ROW_BYTES)
    if word_index.count() <= most:  # written tables are counted from their footers
        return look_up(words, word_index, ["_row", id_col]).select(id_col, F.expr("filter(seq, x -> x > 0)").alias("seq"))
    hot = stored(word_index.orderBy("idx").limit(most), "hot-words")  # by descending count
    met = stored(look_up(words, hot, ["_row", id_col], rare=True), "met-words")
    last = hot.agg(F.max("idx")).first()[0]
    places = met.select("_row", F.inline("rare"))
    # place and index as one number
    place = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("idx").cast("int")
    rare = (places.join(word_index.where(F.col("idx") > last).select("term", "idx"), "term")
            .groupBy("_row").agg(F.collect_list(place).alias("_rare")))
    return fill_in(met.select("_row", id_col, "seq").join(rare, "_row", "left"), id_col)


def pad_sequences(seq, maxlen: int = 400, value: int = 0) -> F.Column:
    """F16: cut at the front to ``maxlen``, pad at the end with ``value``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.size(s)
    cut = F.when(n > maxlen, F.slice(s, n - maxlen + 1, maxlen)).otherwise(s)
    pad = F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(maxlen) - F.size(cut),
                                                              F.lit(0)))
    return F.concat(cut, pad)


def truncate_sequences(seq, maxlen: int = 400) -> F.Column:
    """The kept part of F16 without the padding (padding is implicit zeros)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.size(s)
    return F.when(n > maxlen, F.slice(s, n - maxlen + 1, maxlen)).otherwise(s)
