"""Leave-one-out target encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.scalars import noise_factor
from lagwise.operators.lookup import lookup_join, small_key_sets


@dataclass(frozen=True)
class Encoding:
    """One encoded column: key columns, shrinkage weight and, optionally, a noise spread."""

    name: str
    keys: tuple[str, ...]
    k: float
    noise: float | None = None


def _statistics(df: DataFrame, keys: Sequence[str], y: str, prior: str, mask: Column) -> DataFrame:
    """(keys, _rows, _n, _y, _p): all rows of a key, and count, sum of y and of the prior over
    its masked rows with a known y."""
    used = mask & F.col(y).isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(F.when(used, 1)).alias("_n"),
        F.sum(F.when(used, F.col(y))).alias("_y"),
        F.sum(F.when(used, F.col(prior))).alias("_p"),
    )


def _without_own(y: str, prior: str, mask: Column, k: float) -> dict[str, Column]:
    """The encoded columns from joined statistics; masked rows take their own label out."""
    found_n = F.coalesce("_n", F.lit(0))
    found_y = F.coalesce("_y", F.lit(0))
    n = F.when(mask, found_n - 1).otherwise(found_n)
    total = F.when(mask, found_y - F.col(y)).otherwise(found_y)
    p, weight = F.col(prior), F.lit(float(k))
    return {
        "count_x": n,
        "sum_y": total,
        "avg_p": F.coalesce(F.try_divide("_p", "_n"), F.lit(0.0)),
        "exp_y": F.coalesce(F.try_divide(total, n), p),
        "adj_y": F.coalesce(F.try_divide(total + p * weight, n + weight), p),
    }


def target_encode(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    y: str,
    prior: str,
    mask: Column,
    k: float,
    small: bool = False,
) -> DataFrame:
    """(row_id, keys, count_x, sum_y, avg_p, exp_y, adj_y).

    Statistics come from masked rows with a known ``y``; a masked row's own value is taken out
    again, so its encoding never contains its own label. ``exp_y`` is the plain mean, ``adj_y``
    the mean shrunk towards ``prior`` with weight ``k``; both fall back to ``prior``. Keys
    never seen count as 0.
    """
    rows = df.select(
        *dict.fromkeys([row_id, *keys, y, prior]), F.coalesce(mask, F.lit(False)).alias("_mask")
    )
    stats = _statistics(rows, keys, y, prior, F.col("_mask"))
    joined = lookup_join(rows, stats, keys, row_id, "_rows", small)
    encoded = _without_own(y, prior, F.col("_mask"), k)
    return joined.select(
        row_id,
        *[c for c in keys if c != row_id],
        *[column.alias(name) for name, column in encoded.items()],
    )


def target_encode_all(
    df: DataFrame, row_id: str, y: str, prior: str, mask: Column, encodings: Sequence[Encoding]
) -> DataFrame:
    """(row_id, one ``adj_y`` column per encoding).

    One sketch pass over the keys decides per encoding between broadcast and shuffle; the
    columns are then added to the same rows one after another, so encodings with few keys cost
    no shuffle of the rows at all. Noise, if any, multiplies masked rows only.
    """
    keys = [key for e in encodings for key in e.keys]
    rows = df.select(
        *dict.fromkeys([row_id, y, prior, *keys]), F.coalesce(mask, F.lit(False)).alias("_mask")
    )
    masked = F.col("_mask")
    result = rows
    # shuffled lookups first, while the rows are still narrow
    plan = sorted(zip(small_key_sets(rows, [e.keys for e in encodings]), encodings), key=lambda x: x[0])
    for is_small, e in plan:
        stats = _statistics(rows, e.keys, y, prior, masked)
        joined = lookup_join(result, stats, e.keys, row_id, "_rows", is_small)
        value = _without_own(y, prior, masked, e.k)["adj_y"]
        if e.noise is not None:
            noisy = value * noise_factor(F.col(row_id), e.noise, e.name)
            value = F.when(masked, noisy).otherwise(value)
        result = joined.withColumn(e.name, value).drop("_n", "_y", "_p")
    return result.select(row_id, *[e.name for e in encodings])
