"""Connected components by alternating stars.

Large star: every node hands its larger neighbours to the smallest node it
knows. Small star: every node hands its smaller neighbours and itself to the
smallest. The edge list shrinks to one star per component in a few rounds; each
round is two aggregations and two joins, written once, so a lost executor reads
the round's table again. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stored


def _hand_over(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each row (u, v) becomes (v, smallest neighbour of u), and (u, smallest)."""
    rows = edges.select("u", "v")
    if both_ways:
        rows = rows.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if both_ways:
        out = rows.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (rows.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) of every node that has an edge to another;
    the component is its smallest node. Repeated edges, loops and nulls do no
    harm; an empty edge list gives an empty result."""
    e = stored(edges.where(F.col(a) != F.col(b))
               .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # Done when a star forest is left: no node has two parents, no parent
        # is a child.
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")) \
            .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_ = (ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
                 .where("c > 1 or (c = 1 and p = 1)"))
        if open_.isEmpty():
            break
        e = stored(_hand_over(_hand_over(e, True), False), "edges")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
