"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import stored

#: The ASCII white space that separates words in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``_id`` and ``_text`` (null becomes empty), so that no other column
    of the caller can clash with an operator's own names."""
    return df.select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("_text"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                salts: int = 16) -> DataFrame:
    """Equi-join in which one key of ``left`` may hold a third of its rows.

    ``left`` rows are dealt over ``salts`` sub-keys by a hash of all their
    columns, ``right`` (one row a key) is repeated once for every sub-key and
    never broadcast. The result is that of the plain join.
    """
    cols = [col(c) for c in left.columns]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    on = reduce(lambda a, b: a & b, [spread[c].eqNullSafe(copies[c]) for c in [*keys, "_salt"]])
    drop = [copies[c] for c in [*keys, "_salt"]]
    return reduce(lambda d, c: d.drop(c), drop, spread.join(copies, on, how)).drop("_salt")


#: Rows of a few numbers that may be broadcast (at most 16 to 64 MB); beyond it
#: Spark joins them by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, and broadcast if its rows, counted, are few."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def released(rows, forget=None):
    """The generator ``rows``; when its task ends, ``forget`` is called and freed
    memory goes back to the system. Spark keeps Python workers for later tasks and stages, which would
    otherwise add up their peaks."""
    try:
        yield from rows
    finally:
        if forget is not None:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def text_sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")), 256))


def unclear_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(``_unclear``): ids that several rows have, or null; a decision on one
    of these is not that of a single row."""
    ids = df.groupBy(col(id_col).alias("_unclear")).agg(F.count(F.lit(1)).alias("_rows"))
    return stored(ids.where("_rows > 1 or _unclear is null").select("_unclear"), "unclear-ids")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
