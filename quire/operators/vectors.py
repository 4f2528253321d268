"""Long form (id, idx, value) -> Spark ML sparse vectors.

Grouping is by document id, so a group is bounded by one document's distinct
features. A sparse vector is stored as the struct (type, size, indices, values);
rows are written with that struct and read back as vectors, so that no Python
touches them, and the written rows are what models are fitted on.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import scratch_path


def assemble(rows: DataFrame, features: DataFrame, size: int, id_col: str,
             out_col: str = "features") -> DataFrame:
    """Add ``out_col`` (sparse vector of width ``size``) to every row of ``rows``;
    rows without features get an all-zero vector."""
    cells = (features.where(F.col("idx").isNotNull())
             .groupBy(id_col)
             .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"),
                                                       F.col("value").alias("v"))))
                  .alias("_c")))
    joined = rows.join(cells, id_col, "left")
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
                      F.coalesce(F.col("_c.i"), F.array().cast("array<int>")).alias("indices"),
                      F.coalesce(F.col("_c.v"), F.array().cast("array<double>")).alias("values"))
    path = scratch_path(rows.sparkSession, "vectors")
    joined.withColumn(out_col, sparse).drop("_c").write.parquet(path)
    schema = T.StructType([*[f for f in joined.schema if f.name != "_c"], T.StructField(out_col, VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)
