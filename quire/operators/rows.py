"""Stable, gap-free row numbers without a single-partition window.

``row_number() OVER (ORDER BY k)`` moves every row into one task. Here the
rows are range-partitioned and sorted on the key, each partition is counted
(one small aggregate: a row per partition), and a row's number is its
partition's offset plus its position inside the partition. Only the
per-partition counts reach the driver, so the work and memory per task stay
bounded however large the table is.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import durable, stored

_LOW_BITS = (1 << 33) - 1


def deal_by(df: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """Rows hash-partitioned by ``key`` in numbers that grow with the scan of
    ``like`` (written; ``df`` itself if not given), four to a task of it: what one
    task then counts or sorts stays as large however large the table is. Left to
    itself, the number of shuffle partitions is fixed, and lowered by the bytes of
    what is shuffled, not of what is made of it."""
    fixed = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(fixed, 4 * (df if like is None else like).rdd.getNumPartitions()), key)


def with_row_index(df: DataFrame, order_cols, name: str = "row_id",
                   num_partitions: int | None = None, columnar: bool = False) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    ``columnar`` writes the sorted rows as compressed Parquet, in one pass, where
    a checkpoint sorts them twice and writes them plain; their columns must be of
    types that Parquet knows.

    The order key must be unique (add a tie-breaker otherwise); with a unique
    key the range partitioning, the in-partition order and therefore the
    numbers are the same when a lost partition is recomputed.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    spark = df.sparkSession
    if num_partitions is None:
        num_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample whose order depends on shuffle fetch
    # order, so two jobs over the same plan may cut differently. The sorted,
    # tagged rows are therefore written once (in the shared checkpoint
    # folder) and both the counts and the numbering read
    # that table; it also cuts the lineage for lost executors.
    ranged = (df.repartitionByRange(num_partitions, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_rix", F.monotonically_increasing_id()))
    ranged = stored(ranged, "numbered") if columnar else durable(ranged)
    # partition id in the high bits, position in the low 33 bits
    counts = (ranged.select(F.shiftright(F.col("_rix"), 33).alias("_p"))
              .groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
              .collect())
    by_part = {int(r["_p"]): int(r["_n"]) for r in counts}
    top = max(by_part) + 1 if by_part else 0
    sizes = [by_part.get(p, 0) for p in range(top)]
    offsets = [0] + list(accumulate(sizes))[:-1]
    offset_arr = F.array(*[F.lit(o).cast("bigint") for o in offsets]) if offsets else F.array()
    part = F.shiftright(F.col("_rix"), 33).cast("int")
    return (ranged.withColumn(name, F.element_at(offset_arr, part + 1) +
                              F.col("_rix").bitwiseAND(F.lit(_LOW_BITS)))
            .drop("_rix"))
