"""Dataset operators (D2-D5): positional splits and contiguous folds.

Both are integer arithmetic on a row number, so they are narrow
projections: no shuffle, no sampling, the same rows every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positional_split(df: DataFrame, rn_col: str, n_train: int, n_test: int) -> DataFrame:
    """D3: rows [0, n_train) are 'train', [n_train, n_train + n_test) 'test';
    others dropped (a short input just gives fewer rows)."""
    rn = F.col(rn_col)
    part = (F.when(rn < n_train, F.lit("train"))
            .when(rn < n_train + n_test, F.lit("test")))
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def fold_of(rn, n: int, k: int) -> F.Column:
    """Contiguous unshuffled folds; the first ``n % k`` folds are one row
    longer. ``rn`` counts from 0 inside the rows being folded."""
    r = F.col(rn) if isinstance(rn, str) else rn
    q, m = divmod(n, k)
    big = m * (q + 1)
    if q == 0:
        return r.cast("int")
    return F.when(r < big, F.floor(r / (q + 1))).otherwise(
        F.lit(m) + F.floor((r - big) / q)).cast("int")


def contiguous_folds(df: DataFrame, rn_col: str, n: int, k: int = 4,
                     first_rn: int = 0) -> DataFrame:
    """Add ``fold`` in [0, k) to rows numbered ``first_rn .. first_rn + n - 1``."""
    if n < k:
        raise ValueError(f"cannot make {k} folds of {n} rows")
    return df.withColumn("fold", fold_of(F.col(rn_col) - F.lit(first_rn), n, k))
