"""Calendar neighbourhoods and trailing rates, computed on one row per (entity, day).

Raw rows never enter a window partitioned by the entity: they are counted per (entity, day)
first, the windows run over days, and the result is joined back on (entity, day) so that a hot
entity is spread over its days. NULL entities form one group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.functions.dates import day_number, year_month


def day_profile(df: DataFrame, keys: Sequence[str], day: str, **measures: Column) -> DataFrame:
    """One row per (keys, day) with the given aggregates."""
    return df.groupBy(*keys, day).agg(*[m.alias(name) for name, m in measures.items()])


def attach_by_day(
    df: DataFrame, profile: DataFrame, keys: Sequence[str], day: str
) -> DataFrame:
    """Left join a per-day table on (keys, day); NULL keys match each other."""
    renamed = profile.withColumnsRenamed({c: f"_p_{c}" for c in [*keys, day]})
    matches = [df[c].eqNullSafe(renamed[f"_p_{c}"]) for c in keys]
    matches.append(df[day] == renamed[f"_p_{day}"])
    return df.join(renamed, matches, "left").drop(*[f"_p_{c}" for c in [*keys, day]])


def around(key: str, day: str, low: int, high: int):
    """Window over the days from ``low`` to ``high`` days away, current day at 0."""
    return W.partitionBy(key).orderBy(day_number(F.col(day))).rangeBetween(low, high)


def neighbour_counts(
    df: DataFrame,
    key: str,
    day: str,
    spans: Mapping[str, tuple[int, int]] | None = None,
    month: str | None = None,
    offsets: Mapping[str, int] | None = None,
) -> DataFrame:
    """(key, day, counts) with one column per span, per month and per single-day offset.

    Spans reach into later days as well, so they cannot be used where only the past is known.
    """
    daily = day_profile(df, [key], day, _n=F.count(F.lit(1)))
    columns: list[Column] = []
    for name, (low, high) in (spans or {}).items():
        columns.append(F.sum("_n").over(around(key, day, low, high)).alias(name))
    if month:
        per_month = W.partitionBy(key, year_month(F.col(day)))
        columns.append(F.sum("_n").over(per_month).alias(month))
    for name, offset in (offsets or {}).items():
        count = F.sum("_n").over(around(key, day, offset, offset))
        columns.append(F.coalesce(count, F.lit(0)).alias(name))
    return daily.select(key, day, *columns)


def total_before_day(profile: DataFrame, key: str, day: str, measure: str, name: str) -> DataFrame:
    """(key, day, sum of ``measure`` over strictly earlier days); input has one row per day."""
    earlier = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum(measure).over(earlier), F.lit(0))
    return profile.select(key, day, total.alias(name))


def trailing_rate(
    df: DataFrame, day: str, score: str, frames: Mapping[str, int], lag_rows: int = 1
) -> DataFrame:
    """Daily count and score sum, and the mean score over the previous n rows of that table.

    The mean is NULL until n daily rows precede the day. The only window without a partition
    key runs over the daily table, whose size is the number of calendar days.
    """
    daily = df.groupBy(day).agg(
        F.count(F.lit(1)).alias("day_cnt"), F.sum(score).alias("day_sum")
    )
    ordered = W.orderBy(day)
    columns = []
    for name, rows in frames.items():
        frame = ordered.rowsBetween(-(rows - 1) - lag_rows, -lag_rows)
        mean = F.try_divide(F.sum("day_sum").over(frame), F.sum("day_cnt").over(frame))
        columns.append(F.when(F.count(F.lit(1)).over(frame) == rows, mean).alias(name))
    return daily.select(day, "day_cnt", "day_sum", *columns)


def trailing_rate_by_days(
    df: DataFrame, day: str, score: str, frames: Mapping[str, int]
) -> DataFrame:
    """As ``trailing_rate`` but over calendar days, whether or not each day has rows."""
    daily = df.groupBy(day).agg(
        F.count(F.lit(1)).alias("day_cnt"), F.sum(score).alias("day_sum")
    )
    ordered = W.orderBy(day_number(F.col(day)))
    columns = []
    for name, days in frames.items():
        frame = ordered.rangeBetween(-days, -1)
        mean = F.try_divide(F.sum("day_sum").over(frame), F.sum("day_cnt").over(frame))
        columns.append(mean.alias(name))
    return daily.select(day, "day_cnt", "day_sum", *columns)


def daily_mean(df: DataFrame, day: str, score: str, end) -> DataFrame:
    """(day, mean score, days to ``end``); the mean is NULL if any score of the day is."""
    mean = F.when(F.count(score) == F.count(F.lit(1)), F.avg(score))
    return df.groupBy(day).agg(mean.alias("pred_mean")).withColumn(
        "days_to_end", F.datediff(F.lit(end), F.col(day))
    )
