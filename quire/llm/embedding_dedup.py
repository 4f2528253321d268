"""Operator 6: near-duplicate vectors by an exact metric range join.

On unit vectors a cosine bound is a Euclidean distance bound r. Pivots, drawn
from a bounded sample, partition the vectors of each label into cells (nearest
pivot). Each vector lies in one block, neighbouring cells beside each other, and
by the triangle inequality two blocks, or two tiles of them, hold no link if
their distances to some pivot are more than r apart. Vectors are copied only to
the pairs of blocks that are left, and a block is as large as a task may hold, so
vectors that no pivot tells apart are copied a few times, not once per cell.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col
from quire.llm.components import components
from quire.operators.hot_join import hot_join
from quire.session import ship_package, stored
from quire.sources.papers import load_table

#: Vectors that pivots are drawn from, vectors per pivot and most pivots.
SAMPLE, PER_PIVOT, MOST_PIVOTS = 2048, 4096, 256
#: Bytes of a block's vectors as doubles; a task joins two blocks.
BLOCK_BYTES = 16 << 20
#: Vectors of a tile; two tiles are compared at once.
TILE = 1024
SLACK = 1e-7
#: What a class's result takes in a broadcast, and the bytes of common classes that are broadcast.
RESULT_ROW_BYTES, COMMON_BYTES = 64, 1 << 20


def _prepare(kind: pa.DataType):
    def run(batches):
        """Key, length and components, as ``kind``, of every usable vector."""
        for batch in batches:
            column = batch.column(2)
            lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64(), safe=False).fill_null(math.nan).to_numpy(zero_copy_only=False)
            flat = flat + 0.0  # one zero, not two
            starts, some = np.cumsum(lengths) - lengths, lengths > 0
            ok = some.copy()
            if some.any():
                ok[some] = np.logical_and.reduceat(np.isfinite(flat), starts[some]) & np.logical_or.reduceat(flat != 0, starts[some])
            keys = [hashlib.blake2b(flat[i:i + n].tobytes(), digest_size=16).digest() if use else None
                    for i, n, use in zip(starts.tolist(), lengths.tolist(), ok.tolist())]
            kept, unused = np.where(ok, lengths, 0), pa.array(~ok)
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()),
                                               pa.array(flat[np.repeat(ok, lengths)]).cast(kind), mask=unused)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(lengths.astype(np.int32), mask=~ok), vectors],
                ["_id", "label", "key", "dim", "v"])
    return run


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of ``n`` rows of the sample of unit vectors."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row's direction to each pivot."""
    x = _unit(x)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _by_dim(batches, pivots: dict[int, np.ndarray]):
    """Rows of one length at a time, with their distances to its pivots."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            p = pivots.get(int(dim), np.zeros((1, int(dim))))
            yield part, _distances(_matrix(part.column("v")), p)


def _cells(batches, pivots: dict[int, np.ndarray]):
    """The rows with their cell, the number of the nearest pivot."""
    for part, d in _by_dim(batches, pivots):
        yield part.append_column("cell", pa.array(d.argmin(axis=1), pa.int32()))


def _bounds(batches, pivots: dict[int, np.ndarray]):
    """(g, pivot, lo, hi): least and greatest distance to each pivot of the rows of
    a block ``g`` in a batch."""
    for part, d in _by_dim(batches, pivots):
        blocks, at = np.unique(part.column("g").to_numpy(), return_inverse=True)
        lo, hi = _spans(d, at, len(blocks))
        n = d.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(blocks, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(blocks))),
                                          pa.array(lo.reshape(-1)), pa.array(hi.reshape(-1))], ["g", "pivot", "lo", "hi"])


def _spans(d: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each column of ``d`` in each of ``n`` groups of rows."""
    lo, hi = np.full((n, d.shape[1]), np.inf), np.full((n, d.shape[1]), -np.inf)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    if len(starts):
        lo[group[order][starts]] = np.minimum.reduceat(d[order], starts)
        hi[group[order][starts]] = np.maximum.reduceat(d[order], starts)
    return lo, hi


class _Side:
    """The rows of a block, in order of their cells, in tiles."""

    def __init__(self, t: pa.Table, pivots: dict[int, np.ndarray]):
        t = t.take(pc.sort_indices(t.column("cell")))
        x = _matrix(t.column("v").combine_chunks())
        self.cls, self.w = t.column("cls").to_numpy(), t.column("w").to_numpy()
        self.n, self.links = len(x), np.zeros(len(x), np.int64)
        self.tiles = [slice(lo, min(lo + TILE, len(x))) for lo in range(0, len(x), TILE)]
        if len(x):
            d = _distances(x, pivots.get(x.shape[1], np.zeros((1, x.shape[1]))))
            self.lo, self.hi = _spans(d, np.arange(len(x)) // TILE, len(self.tiles))
            self.x = x / np.abs(x).max(axis=1, keepdims=True)
            self.size = np.sqrt((self.x * self.x).sum(1))
            self.rough = (self.x / self.size[:, None]).astype(np.float32)


def _linked(a: _Side, s: slice, b: _Side, t: slice, least: float, slack: float):
    """Rows and columns of two tiles that may link, and which of these pairs do."""
    may = a.rough[s] @ b.rough[t].T >= np.float32(least - slack)
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    rows, cols = rows + s.start, cols + t.start
    if not len(rows):
        return rows, cols, np.zeros((0, 0), bool)
    cosine = (a.x[rows] @ b.x[cols].T) / a.size[rows][:, None] / b.size[cols][None, :]
    return rows, cols, cosine >= least


def _join_blocks(least: float, pivots: dict[int, np.ndarray]):
    far = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK

    def join(table: pa.Table) -> pa.Table:
        """Links of one pair of blocks: counts per vector and edges to the
        smallest vector of the part they connect."""
        left, right = (_Side(table.filter(pa.array(table.column("side").to_numpy() == s)), pivots) for s in (0, 1))
        same = right.n == 0
        right = left if same else right
        cls = left.cls if same else np.concatenate([left.cls, right.cls])
        shift = 0 if same else left.n
        # single precision errs by less than this
        slack = 1.2e-7 * (left.x.shape[1] + 8) if left.n else 0.0
        ends = []
        for i, s in enumerate(left.tiles):
            gap = np.maximum(left.lo[i] - right.hi, right.lo - left.hi[i]).max(axis=1)
            for j, t in enumerate(right.tiles):
                if (same and j < i) or gap[j] > far:
                    continue
                rows, cols, linked = _linked(left, s, right, t, least, slack)
                if same and i == j:
                    linked &= rows[:, None] != cols[None, :]
                if not linked.any():
                    continue
                left.links[rows] += linked @ right.w[cols]
                if not same or i != j:
                    right.links[cols] += linked.T @ left.w[rows]
                la, lb = _least_connected(linked, left.cls[rows], right.cls[cols])
                for at, own, to in ((rows, linked.any(axis=1), la), (cols + shift, linked.any(axis=0), lb)):
                    ends.append((at[own], to[own]))
        n = left.links if same else np.concatenate([left.links, right.links])
        root = _roots(cls, ends)
        some = n > 0
        return pa.table({"cls": pa.array(cls[some], pa.int64()), "n": pa.array(n[some], pa.int64()),
                         "root": pa.array(root[some], pa.int64())})
    return join


def _least_connected(linked: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns the smallest class that these links connect them with."""
    top = np.iinfo(np.int64).max
    while True:
        before = la, lb
        la = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1, initial=top))
        lb = np.minimum(lb, np.where(linked, la[:, None], top).min(axis=0, initial=top))
        if (la == before[0]).all() and (lb == before[1]).all():
            return la, lb


def _roots(cls: np.ndarray, ends: list) -> np.ndarray:
    """The smallest class each one is connected with by ``ends``: places in ``cls``
    and classes they are connected with."""
    root = cls.copy()
    if not ends:
        return root
    at, to = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
    order = np.argsort(cls, kind="stable")
    to = order[np.searchsorted(cls[order], to)]
    while True:
        before = root.copy()
        np.minimum.at(root, at, root[to])
        np.minimum.at(root, to, root[at])
        if (root == before).all():
            return root


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", least: float = 0.93, block: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link when their labels are equal and not null and their cosine,
    in double precision, is at least ``least``. Vectors that are null, empty,
    zero or hold null or non-finite components, and those of other length, link
    with nothing; such a row is its own component. Copies count as links of
    each other but are compared once. Rows that repeat an id are separate
    vectors. A null id stays null and is never a component's smallest. An empty
    table gives an empty result; other columns are ignored. ``block`` is the
    number of vectors of a block (``BLOCK_BYTES`` of them if not given).
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(col(id_col).cast("long").alias("_id"), col(label_col).alias("label"), col(vector_col).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)  # doubles of these would be the same numbers
    vector = "array<float>" if single else "array<double>"
    ready = rows.mapInArrow(_prepare(pa.float32() if single else pa.float64()), f"_id long, label {kind}, key binary, dim int, v {vector}") \
        .withColumn("key", F.when(F.col("label").isNotNull(), F.col("key"))) \
        .withColumn("cls", F.when(F.col("key").isNotNull(), F.xxhash64("label", "key")))
    # Vectors are shuffled and written once, a row a class.
    vectors = stored(ready.select("_id", "cls"), "vectors")
    classes = stored(ready.where("cls is not null").groupBy("cls", "label", "dim")
                     .agg(F.count(F.lit(1)).alias("w"), F.min("_id").alias("least"), F.any_value("v").alias("v")),
                     "vector-classes")
    pivots = {}
    for dim, n in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect():
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").collect()
        unit = _unit(np.array([s["v"] for s in sample]))
        pivots[dim] = choose_pivots(unit, max(1, min(MOST_PIVOTS, math.ceil(n / PER_PIVOT))))
    cells = classes.select("cls", "w", "label", "dim", "v").mapInArrow(
        lambda it: _cells(it, pivots), f"cls long, w long, label {kind}, dim int, v {vector}, cell int")
    # The vectors of a label follow each other by cell; a block is a run of them.
    size = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    own, label = Window.partitionBy("label", "dim").orderBy("cell"), Window.partitionBy("label", "dim")
    places = stored(cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("start", F.sum("n").over(own) - F.col("n")).withColumn("total", F.sum("n").over(label))
                    .where("total > 1").withColumn("size", size.cast("long")), "vector-places")
    name = F.xxhash64("label", "dim", "block").alias("g")
    placed = cells.join(places, ["label", "dim", "cell"]).withColumn(
        "block", F.floor((F.col("start") + F.pmod(F.xxhash64("cls", F.lit(3)), F.col("n"))) / F.col("size")).cast("int"))
    blocks = places.groupBy("label", "dim").agg(F.ceil(F.max("total") / F.max("size")).cast("int").alias("blocks"))
    bounds = placed.where("total > size").select(name, "dim", "v").mapInArrow(
        lambda it: _bounds(it, pivots), "g long, pivot int, lo double, hi double") \
        .groupBy("g", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = stored(blocks.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                     .withColumn("g", name).join(bounds, "g").select("label", "dim", "block", "pivot", "lo", "hi"), "vector-bounds")
    first, second = (several.select("label", "dim", "pivot", F.col("block").alias(b), F.col("lo").alias("lo" + b), F.col("hi").alias("hi" + b))
                     for b in ("first", "second"))
    gap = F.max(F.greatest(F.col("lofirst") - F.col("hisecond"), F.col("losecond") - F.col("hifirst")))
    near = first.join(second, ["label", "dim", "pivot"]).where("first <= second").groupBy("label", "dim", "first", "second") \
        .agg(gap.alias("gap")).where(F.col("gap") <= math.sqrt(max(0.0, 2 - 2 * least)) + SLACK)
    pairs = stored(near.select("label", "dim", "first", "second").unionByName(
        blocks.where("blocks = 1").select("label", "dim", F.lit(0).alias("first"), F.lit(0).alias("second"))), "vector-pairs")
    partners = pairs.withColumn("block", F.col("first")).withColumn("side", F.lit(0)).unionByName(
        pairs.where("first <> second").withColumn("block", F.col("second")).withColumn("side", F.lit(1)))
    dealt = placed.join(partners, ["label", "dim", "block"])
    found = stored(dealt.select("label", "dim", "first", "second", "side", "cls", "w", "cell", "v")
                   .groupBy("label", "dim", "first", "second")
                   .applyInArrow(_join_blocks(least, pivots), "cls long, n long, root long"), "vector-links")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))) \
        .withColumnRenamed("node", "cls")
    per = (classes.select("cls", "w", "least").join(links, "cls", "left").join(comp, "cls", "left")
           .withColumn("component", F.coalesce("component", "cls")))
    smallest = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = stored(per.join(smallest, "component").select(
        "cls", "w", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "vector-results")
    used = hot_join(vectors.where("cls is not null"), per, "cls", "w", RESULT_ROW_BYTES, "_id", COMMON_BYTES)
    alone = vectors.where("cls is null").select("_id", "cls", F.lit(0).cast("long").alias("n_links"),
                                                F.col("_id").alias("component_id"))
    out = used.select("_id", "cls", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(load_table(spark, sf_dir, "embeddings"))
