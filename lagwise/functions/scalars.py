"""Flags, codes, rates, clamps and reproducible pseudo-random numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least would replace it)."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def flag_or_zero(flag: Column) -> Column:
    """'t' gives 1, everything else including NULL gives 0."""
    return F.coalesce(flag == "t", F.lit(False)).cast("int")


def flag_strict(flag: Column) -> Column:
    """'t' gives 1, 'f' gives 0, everything else NULL."""
    return F.when(flag == "t", F.lit(1)).when(flag == "f", F.lit(0))


def flag_keep_null(flag: Column) -> Column:
    """'t' gives 1, any other known value 0, NULL stays NULL."""
    return (flag == "t").cast("int")


def reaches(count: Column, threshold: float = 1) -> Column:
    """1 when the count is known and at least ``threshold``, else 0."""
    return F.coalesce(count >= threshold, F.lit(False)).cast("int")


def ordinal(
    value: Column,
    levels: Sequence[str],
    first: int = 1,
    blank: int | None = None,
    default: int | None = None,
) -> Column:
    """Code ``levels`` as first, first+1, ...; NULL or '' as ``blank``; unknown as ``default``."""
    code = F.when(value.isNull() | (value == ""), F.lit(blank).cast("int"))
    for offset, level in enumerate(levels):
        code = code.when(value == level, F.lit(first + offset))
    return code.otherwise(F.lit(default).cast("int"))


def label_blank(value: Column, label: str) -> Column:
    """Replace NULL and '' by a label."""
    return F.when(value.isNull() | (value == ""), F.lit(label)).otherwise(value)


def prior_rate(total: Column, count: Column) -> Column:
    """total / count, 0 where the count is 0."""
    return F.when(count == 0, F.lit(0.0)).otherwise(F.try_divide(total, count))


def credibility_rate(total: Column, count: Column, prior: Column, k: float) -> Column:
    """Shrink total / count towards ``prior`` with weight ``k``."""
    return (total + F.lit(float(k)) * prior) / (count + F.lit(float(k)))


def log_offset(value: Column, offset: float = 0.0) -> Column:
    """Natural log of value + offset; NULL where that is not positive."""
    shifted = value + F.lit(float(offset)) if offset else value
    return F.when(shifted > 0, F.log(shifted))


def first_scored(preferred: Column, fallback: Column, zero_is_missing: bool = True) -> Column:
    """Out-of-fold score where there is one, else the score of the full fit.

    With ``zero_is_missing`` a stored 0 counts as "no score", the marker text scores start from.
    """
    missing = preferred.isNull()
    if zero_is_missing:
        missing = missing | (preferred == 0)
    return F.when(missing, fallback).otherwise(preferred)


def uniform_from_id(row_id: Column, salt: str = "") -> Column:
    """Uniform number in [0, 1) that depends only on the id and the salt.

    Unlike rand() the value is the same under any partitioning and after a task retry.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def noise_factor(row_id: Column, spread: float, salt: str = "") -> Column:
    """Multiplier 1 + (u - 0.5) * spread."""
    return F.lit(1.0) + (uniform_from_id(row_id, salt) - 0.5) * F.lit(float(spread))


def even_fold(u: Column, folds: int) -> Column:
    """Fold 0..folds-1 from left-closed bands [i/folds, (i+1)/folds)."""
    return F.floor(u * folds).cast("int")


def descending_fold(u: Column, folds: int) -> Column:
    """Fold 1..folds from right-closed bands counted from the top; 0 falls in the last."""
    return F.least(F.lit(folds), F.lit(folds + 1) - F.ceil(u * folds)).cast("int")
