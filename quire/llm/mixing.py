"""Operator 4: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target is made of
whole passes over it and a remaining budget. Of that budget every length first
gives its proportional number of documents, seeded draws decide for the parts of
documents that are left, whatever their lengths, and the last few thousand words
are fitted by a bounded-knapsack dynamic programme over the counts of unused
documents per length. Documents are chosen by seeded hash order within their source and
length, cut into sub-ranges of the hash so that no single task ranks a large
group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.common import WORD, col, salted_join, small, text_sha, unclear_ids
from quire.operators.rows import with_row_index
from quire.session import ship_package, stored
from quire.sources.papers import load_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Documents that one task ranks at a time within a source and length.
RANKED_TOGETHER = 4096
#: Words that seeded draws leave to the dynamic programme.
TAIL = 1 << 13


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(``source``, ``source_size``, ``target``): sources in code-point order,
    null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``most`` times its source's size and the excess is reshared
    by weight among the others until none is above."""
    ranked = with_row_index(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    t = stored(ranked.select("source", "source_size", weight.alias("w"),
                             (F.lit(most) * F.col("source_size")).cast("double").alias("cap")), "mix-sources")
    whole = float(t.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    # The sources that stop are those whose cap per weight is at most the
    # level; each round adds to them, so it ends. Three sums reach the driver.
    while True:
        stops = F.col("cap") <= F.col("w") * F.lit(level)
        cap, free, n = t.agg(F.sum(F.when(stops, F.col("cap")).otherwise(0.0)),
                             F.sum(F.when(stops, 0.0).otherwise(F.col("w"))), F.count_if(stops)).first()
        if n == capped or not free:
            break
        capped, level = n, (whole - (cap or 0.0)) / free
    return t.select("source", "source_size", F.when(F.col("cap") <= F.col("w") * F.lit(level), F.col("cap"))
                    .otherwise(F.col("w") * F.lit(level)).alias("target"))


def draws(lengths: np.ndarray, seed: int) -> np.ndarray:
    """A seeded number in (0, 1) for every length."""
    with np.errstate(over="ignore"):
        x = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2 ** 64) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order) -> np.ndarray:
    """How many documents of each length, at most ``counts``, add up to the
    largest sum of words not above ``budget``; of equal sums, the one first
    reached when lengths are tried in ``order``. Bounded knapsack: pieces of 1, 2,
    4 ... documents of a length; ``via`` keeps the piece that first reached a sum."""
    via = np.full(budget + 1, -1, dtype=np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    pieces = []
    for i in order:
        left, step, size = int(counts[i]), 1, int(lengths[i])
        left = min(left, budget // size) if size else 0
        while left and not reached[budget]:
            n = min(step, left)
            new = np.zeros(budget + 1, dtype=bool)
            new[n * size:] = reached[:budget + 1 - n * size]
            new &= ~reached
            via[new] = len(pieces)
            pieces.append((i, n))
            reached |= new
            left -= n
            step *= 2
    take = np.zeros(len(lengths), dtype=np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = pieces[via[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 42, tail: int = TAIL) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, so that
    their words come as near to ``budget`` as the programme finds, never above.

    Every length gives its proportional number, rounded down. What the rounding
    leaves of a length, a part of one document, is drawn for systematically: the
    parts are laid end to end from the shortest length to the longest, and a
    length is taken where its part holds one of the marks, a document apart from
    a seeded start. So each is taken with the chance of its part, and no range of
    lengths gets more than one document too many. Lengths in the order of a second
    draw then leave or join until about ``tail`` words are open, which the
    knapsack fills, trying lengths in the same order.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    # floats only propose; the integers below decide
    share = counts * (budget / total)
    take = np.minimum(counts, np.floor(share).astype(np.int64))
    rest = budget - int((lengths * take).sum())
    while rest < 0:  # a float may have proposed one too many
        i = np.flatnonzero((take > 0) & (lengths > 0))[0]
        take[i] -= 1
        rest += int(lengths[i])
    by_draw = np.argsort(draws(lengths, seed), kind="stable")
    part = np.where(lengths > 0, share - np.floor(share), 0.0)
    ends = np.cumsum(part) + draws(np.zeros(1), seed + 1)[0]
    drawn = (np.floor(ends) > np.floor(ends - part)) & (take < counts) & (lengths > 0)
    rest -= int(lengths[drawn].sum())
    for i in by_draw[drawn[by_draw]]:
        if rest >= 0:
            break
        drawn[i] = False
        rest += int(lengths[i])
    take += drawn
    for i in by_draw:
        if rest <= tail:
            break
        if part[i] > 0 and not drawn[i] and take[i] < counts[i] and int(lengths[i]) <= rest - tail // 2:
            take[i] += 1
            rest -= int(lengths[i])
    # Longer rests are left only where every open length is longer still.
    return take + knapsack(lengths, counts - take, rest, by_draw)


def _fit(most: int, seed: int):
    def fit(table: pa.Table) -> pa.Table:
        t = table.sort_by("size")
        lengths = t.column("size").to_numpy().astype(np.int64)
        counts = t.column("n").to_numpy().astype(np.int64)
        whole = int(t.column("source_size")[0].as_py())
        want = int(round(t.column("target")[0].as_py()))
        passes = min(most, want // whole) if whole else 0
        extra = fit_lengths(lengths, counts, want - passes * whole, seed) if passes < most \
            else np.zeros(len(lengths), np.int64)
        return pa.table({"source": t.column("source"), "size": t.column("size"), "n": t.column("n"),
                         "source_size": t.column("source_size"), "target": t.column("target"),
                         "passes": pa.array(np.full(len(lengths), passes), pa.int32()),
                         "extra": pa.array(extra, pa.int64())})
    return fit


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 42) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``taken``.

    ``taken`` is the row's size times its repeats, 0 to ``most``. Texts without
    words, null ones too, have size 0 and take 0. A null source is a source of
    its own, last in order. Rows that repeat, or tie in the seeded order, are
    told apart by their place in the stored table of sizes. An empty table gives
    an empty result; other columns are ignored. Equal tables read in equal
    files give equal mixes.
    """
    return _mix(df, id_col, text_col, source_col, weights, most, seed, [])


def _mix(df, id_col, text_col, source_col, weights, most, seed, more: list[Column]) -> DataFrame:
    """:func:`mix`, with ``more`` columns of ``df`` in its rows."""
    ship_package(df.sparkSession)
    names = df.select(*more).columns
    docs = stored(df.select(*more, col(id_col).alias("_id"), col(source_col).alias("source"),
                            F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
                  .withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    # Map-side sums: a hot source costs one row per task and length.
    counts = stored(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    wanted = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    # A source's group holds its distinct lengths, a few thousand numbers.
    joined = counts.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    kind = docs.schema["source"].dataType.simpleString()
    plan = joined.groupBy("source").applyInArrow(
        _fit(most, seed), f"source {kind}, size long, n long, source_size long, target double, "
        "passes int, extra long")
    plan = stored(plan.withColumn("parts", F.ceil(F.col("n") / F.lit(RANKED_TOGETHER)).cast("long")), "mix-plan")
    rows = salted_join(docs, plan, ["source", "size"], "inner")
    # Seeded order, cut into ``parts`` ranges of its hash; a part's offset is
    # the number of documents in the parts before it.
    order = F.xxhash64("_id", F.lit(seed))
    part = F.least(F.col("parts") - 1, F.floor((order / F.lit(2.0 ** 64) + 0.5) * F.col("parts")))
    rows = rows.withColumn("_order", order).withColumn("_part", part.cast("long"))
    some = rows.where("extra > 0 and extra < n")
    per = some.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("c"))
    before = per.withColumn("before", F.sum("c").over(
        Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))) \
        .select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"),
                F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_order", "_row"))
    chosen = (some.withColumn("_rank", rank)
              .join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) &
                    (F.col("_part") == F.col("_p")))
              .withColumn("_more", (F.col("before") + F.col("_rank") <= F.col("extra")).cast("int")))
    cols = ["_id", "source", "size", "source_size", "target", "passes", "_more", *names]
    out = chosen.select(*cols).unionByName(
        rows.where("extra = 0 or extra = n").withColumn("_more", F.when(F.col("extra") > 0, 1).otherwise(0))
        .select(*cols))
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target",
                      (F.col("size") * (F.col("passes") + F.col("_more"))).cast("long").alias("taken"), *names)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes it.
    Texts without words are dropped. Where ids repeat or are null, rows are
    told apart by source and text; those alike in all three share what they take."""
    if not unclear_ids(df, id_col).isEmpty():
        return _mixed_unclear(df, id_col, text_col, source_col)
    taken = (mix(df, id_col, text_col, source_col).where("taken > 0")
             .select(F.col(id_col).alias("_taken_id"), F.expr("int(taken div size)").alias("_times")))
    out = df.join(small(taken, "taken"), col(id_col).eqNullSafe(F.col("_taken_id")))
    return (out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[col(c) for c in df.columns]))


def _mixed_unclear(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    keys = ["_taken_id", "_taken_source", "_taken_sha"]
    taken = _mix(df, id_col, text_col, source_col, WEIGHTS, MOST_REPEATS, 42,
                 [text_sha(text_col).alias("_taken_sha")]).where("size > 0")
    taken = taken.select(col(id_col).alias("_taken_id"), F.col("source").alias("_taken_source"), "_taken_sha",
                         F.expr("taken div size").alias("_times"))
    taken = taken.groupBy(*keys).agg(F.sum("_times").alias("_total"), F.count(F.lit(1)).alias("_alike"))
    same = col(id_col).eqNullSafe(F.col("_taken_id")) & col(source_col).eqNullSafe(F.col("_taken_source")) \
        & (text_sha(text_col) == F.col("_taken_sha"))
    out = df.join(taken, same).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_alike")))
    # Rows alike take as often, but for one more of some of them.
    times = F.expr("int(_total div _alike + if(_nth <= _total % _alike, 1, 0))")
    return (out.withColumn("_times", times).where("_times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[col(c) for c in df.columns]))
