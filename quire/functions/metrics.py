"""Regression scores (E1-E4) as one aggregation.

MSE, MAE and R^2 come from one pass of partial sums (count, sum of squared
and absolute residuals, sum and sum of squares of the target), so scoring a
prediction table of any size is one map-side-combined aggregate.
R^2 = 1 - SSres/SStot; when all targets are equal (SStot = 0) it is 1.0 if
the residual is also 0, else 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_aggs(label: str = "label", prediction: str = "prediction", digits: int | None = 4):
    """Aggregate expressions (n, mse, mae, r2) for ``df.agg`` / ``groupBy().agg``."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    r = y - p
    n = F.count(F.lit(1))
    ss_res = F.sum(r * r)
    # centred sum of squares in one pass: sum((y - mean)^2) via var_pop * n
    ss_tot = F.var_pop(y) * n
    mse = F.avg(r * r)
    mae = F.avg(F.abs(r))
    r2 = (F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot)
          .when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def rd(c):
        return F.round(c, digits) if digits is not None else c
    return [n.alias("n"), rd(mse).alias("mse"), rd(mae).alias("mae"), rd(r2).alias("r2")]


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by=None, digits: int | None = 4) -> DataFrame:
    """(n, mse, mae, r2) for the whole frame or per group ``by``."""
    aggs = score_aggs(label, prediction, digits)
    if by:
        by = [by] if isinstance(by, str) else list(by)
        return df.groupBy(*by).agg(*aggs)
    return df.agg(*aggs)
