"""Operator 8: secret scans with corpus-wide ownership frequency.

One pass finds the base matches and candidate values of every text; the values
of base matches are candidates whatever they look like. Hashes of the values are
then counted by distinct repositories and owners over the whole corpus: a value
in several owners' texts or in many repositories of one is a copied example, any
other looks live and, if it looks random, is added as a span of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shingles as S
from quire.llm.common import col, salted_join
from quire.session import ship_package, stored
from quire.sources.papers import load_table

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones drop out here
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_VALUE_BYTE = np.zeros(256, dtype=bool)
_VALUE_BYTE[[c for c in range(128) if re.match(r"[A-Za-z0-9+/_=-]", chr(c))]] = True

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("random", pa.bool_())])


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, of matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, least_bits: float) -> list[tuple[int, int]]:
    """Spans of values of 20 or more characters that look random."""
    out = []
    for m in _VALUE.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and entropy(v) >= least_bits:
            out.append(m.span())
    return out


def base_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values of base matches, without those inside another."""
    found = {m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6}
    found |= {m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 20}
    found |= {m.span() for m in _HEX.finditer(text)}
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _meets(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps one of ``others``, whose starts and ends ascend."""
    ends = [b for _, b in others]
    first = [bisect_right(ends, a) for a, _ in spans]
    return [i < len(others) and others[i][0] < b for i, (_, b) in zip(first, spans)]


def rated_values(text: str, least_bits: float) -> list[tuple[int, int, bool]]:
    """(start, end, looks random) of the values to rate: those of base matches,
    and random-looking ones that overlap none of them."""
    known, runs = base_values(text), candidates(text, least_bits)
    out = [(*x, r) for x, r in zip(known, _meets(known, runs))]
    return sorted(out + [(*x, True) for x, taken in zip(runs, _meets(runs, known)) if not taken])


def _worth_reading(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that hold a run of 20 value characters (all hex, access and
    candidate matches do) or a keyword."""
    rows = len(bounds) - 1
    word = _VALUE_BYTE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    # runs may cross rows here; that only makes a row worth reading
    long = ends - starts >= 20
    worth = np.zeros(rows + 1, dtype=bool)
    first = np.searchsorted(bounds, starts[long], "right") - 1
    last = np.searchsorted(bounds, ends[long] - 1, "right") - 1
    for a, b in zip(first, last):
        worth[a:b + 1] = True
    low = data.tobytes().lower()
    for i in np.flatnonzero(~worth[:rows]):
        one = low[bounds[i]:bounds[i + 1]]
        worth[i] = any(k in one for k in _KEYWORDS)
    return worth[:rows]


def _scan(batches, least_bits: float):
    for batch in batches:
        texts = batch.column(1)
        data, bounds = S.buffer_of(texts)
        spans, values = [[]] * batch.num_rows, [[]] * batch.num_rows
        for lo, hi in S.slices(bounds):
            worth = _worth_reading(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
            for i in np.flatnonzero(worth) + lo:
                text = texts[int(i)].as_py() or ""
                spans[i] = [dict(zip(("start", "kind", "end"), x)) for x in base_spans(text)]
                values[i] = [{"value": hashlib.blake2b(text[a:b].encode(), digest_size=16).hexdigest(),
                              "start": a, "end": b, "random": r} for a, b, r in rated_values(text, least_bits)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3),
             pa.array(spans, pa.list_(_SPAN)), pa.array(values, pa.list_(_CANDIDATE))],
            ["_id", "repo", "owner", "base", "candidates"])


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', "
                  "s.start, ':', s.end)), ',')")


def secret_scan(df: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text",
                least_bits: float = 3.0, copied: int = 2, copied_repos: int = 3) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_assign``, ``n_access``,
    ``n_hex``, ``base`` (array of start, kind, end in code points; kinds as in
    ``KINDS``), ``base_sha256``, ``spans`` (all spans, joined), ``n_live``,
    ``n_copied``.

    A value counts as a copied example when ``copied`` or more owners, or
    ``copied_repos`` or more repositories, hold it, and otherwise looks live.
    ``n_copied`` and ``n_live`` count the values of base matches and the
    random-looking ones; only random-looking live values have a live span, the
    others are inside their base match. Null and empty texts have
    no spans; a null repository or owner is a value of its own; ids are
    returned as they are, null or repeated; other columns are ignored. An empty
    table gives an empty result.
    """
    ship_package(df.sparkSession)
    docs = df.select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("_text"),
                     F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"))
    kind = docs.schema["_id"].dataType.simpleString()
    scanned = stored(docs.mapInArrow(
        lambda it: _scan(it, least_bits),
        f"_id {kind}, repo string, owner string, base array<struct<start:int,kind:int,end:int>>, "
        "candidates array<struct<value:string,start:int,end:int,random:boolean>>")
        .withColumn("_row", F.monotonically_increasing_id()), "secret-scan")
    values = scanned.where(F.size("candidates") > 0).select("_row", "repo", "owner", F.explode("candidates").alias("c"))
    owned = values.select("c.value", "repo", "owner").distinct()
    frequency = (owned.groupBy("value").agg(F.count_distinct("owner").alias("owners"),
                                            F.count_distinct("repo").alias("repos")))
    rated = salted_join(values.select("_row", "c.value", "c.start", "c.end", "c.random"), frequency, ["value"])
    example = (F.col("owners") >= copied) | (F.col("repos") >= copied_repos)
    added = rated.groupBy("_row").agg(
        F.collect_list(F.when(~example & F.col("random"), F.struct(
            "start", F.lit(3).alias("kind"), "end"))).alias("live"),
        F.count_if(~example).alias("n_live"), F.count_if(example).alias("n_copied"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    out = scanned.join(added, "_row", "left").withColumn("live", F.coalesce("live", none)) \
        .withColumn("all", F.array_sort(F.concat("base", "live")))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"),
                      count(2).alias("n_hex"), "base", F.sha2(_joined("base"), 256).alias("base_sha256"),
                      _joined("all").alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
                      F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names a source and a language: the owner is the source, its
    repositories are its languages."""
    out = secret_scan(load_table(spark, sf_dir, "documents"),
                      F.concat_ws("/", "source", "lang"), F.col("source"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")
