"""Maturity curve: how much of the final success rate a cohort shows after n days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def maturity_curve(cohort: DataFrame, age: str, y: str, longest: int = 120) -> DataFrame:
    """(age, counts, cumulative counts, pct, factor) for the ages 0..longest.

    ``factor`` is the cumulative success share divided by its largest value. The windows run
    over at most ``longest + 1`` aggregated rows.
    """
    per_age = (
        cohort.filter(F.col(age).between(0, longest))
        .groupBy(age)
        .agg(
            F.count(F.lit(1)).alias("project_cnt"),
            F.coalesce(F.sum(y), F.lit(0)).alias("is_exciting_cnt"),
        )
    )
    up_to = W.orderBy(age).rowsBetween(W.unboundedPreceding, 0)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        per_age.withColumns(
            {
                "project_cnt_cumsum": F.sum("project_cnt").over(up_to),
                "is_exciting_cnt_cumsum": F.sum("is_exciting_cnt").over(up_to),
            }
        )
        .withColumn(
            "is_exciting_pct", F.try_divide("is_exciting_cnt_cumsum", "project_cnt_cumsum")
        )
        .withColumn(
            "factor", F.try_divide("is_exciting_pct", F.max("is_exciting_pct").over(whole))
        )
    )


def attach_factor(df: DataFrame, age: str, curve: DataFrame, curve_age: str) -> DataFrame:
    """Look the factor up by age; NULL for ages the curve does not have.

    The curve has one row per age in 0..longest, so its broadcast size is fixed.
    """
    lookup = F.broadcast(curve.select(F.col(curve_age).alias("_age"), "factor"))
    return df.join(lookup, F.col(age) == F.col("_age"), "left").drop("_age")
