"""Bring a per-key value back onto rows without letting a hot key land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
SALTS = 1024
BROADCAST_KEYS = 50_000


def small_key_sets(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> list[bool]:
    """Whether each key combination has few enough values to broadcast one row per value.

    One pass with mergeable sketches for all combinations. The limit leaves a wide margin
    over the sketch error, so a broadcast side stays within a few megabytes.
    """
    estimates = df.agg(
        *[
            F.approx_count_distinct(F.struct(*keys)).alias(f"_k{i}")
            for i, keys in enumerate(key_sets)
        ]
    ).first()
    return [estimate <= BROADCAST_KEYS // 2 for estimate in estimates]


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    row_id: str,
    weight: str,
    small: bool = False,
) -> DataFrame:
    """Left join ``lookup`` (one row per key) onto ``rows``; NULL keys match each other.

    ``small`` lookups (see ``small_key_sets``) are broadcast. Otherwise the HOT_KEYS keys with
    the largest ``weight`` (rows per key) travel by broadcast, at most that many rows whatever
    the data size, and their rows are salted so the shuffle spreads them evenly. Every other
    key holds less than 1/HOT_KEYS of the rows and goes through the ordinary shuffle join, so
    no row is lost and no task gets a hot key.
    """
    values = [c for c in lookup.columns if c not in keys and c != weight]
    named = lookup.withColumnsRenamed({k: f"_l_{k}" for k in keys})

    if small:
        side = F.broadcast(named.drop(weight))
        matches = [rows[k].eqNullSafe(side[f"_l_{k}"]) for k in keys]
        return rows.join(side, matches, "left").drop(*[f"_l_{k}" for k in keys])

    by_size = [F.col(weight).desc(), *[F.col(f"_l_{k}") for k in keys]]
    hot = named.orderBy(*by_size).limit(HOT_KEYS).select(
        *[F.col(f"_l_{k}").alias(f"_h_{k}") for k in keys],
        F.lit(True).alias("_hot"),
        *[F.col(v).alias(f"_h_{v}") for v in values],
    )
    hot = F.broadcast(hot)
    marked = rows.join(
        hot, [rows[k].eqNullSafe(hot[f"_h_{k}"]) for k in keys], "left"
    ).withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int") + 1).otherwise(0),
    )

    # always 0, but taken from a column: a literal would be folded into a filter on the row
    # side and the salt would no longer be part of the shuffle key
    no_salt = F.least(F.col(weight), F.lit(0)).cast("int")
    rest = named.select(
        *[f"_l_{k}" for k in keys],
        no_salt.alias("_l_salt"),
        *[F.col(v).alias(f"_l_{v}") for v in values],
    )
    matches = [marked[k].eqNullSafe(rest[f"_l_{k}"]) for k in keys]
    matches.append(marked["_salt"] == rest["_l_salt"])
    return marked.join(rest, matches, "left").select(
        *rows.columns,
        *[
            F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_l_{v}")).alias(v)
            for v in values
        ],
    )


def group_mean(
    rows: DataFrame,
    keys: Sequence[str],
    row_id: str,
    means: dict[str, tuple[str, bool]],
    small: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Attach group means: ``means`` maps a new name to (column, strict).

    A strict mean is NULL as soon as one value of the group is NULL; otherwise NULLs are
    skipped. ``source`` is the table the means are taken from, by default ``rows``; pass the
    original table when ``rows`` already went through other joins, so those do not run again
    below the aggregation.
    """
    aggregates = []
    for name, (column, strict) in means.items():
        mean = F.avg(column)
        if strict:
            mean = F.when(F.count(column) == F.count(F.lit(1)), mean)
        aggregates.append(mean.alias(name))
    table = rows if source is None else source
    lookup = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return lookup_join(rows, lookup, keys, row_id, "_rows", small)
