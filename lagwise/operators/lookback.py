"""Features of a row's entity as it stood just before that row.

One entity, or one entity on one day, may own any share of the rows, so rows are scanned in segments. They
are range-sliced on (entity, day, id) and every slice looks back over its own rows. An entity that crosses
the border between slices leaves a carry there: the sum, maximum, minimum and last value of its rows in the
slices before. There are at most two such entities per slice, its first and its last, so the carries are a
table of that size, which is broadcast. Nothing is ever gathered by entity. Rows without an entity have no
past and take a separate branch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.session import in_part, materialize, part_count, store_parts

FIRST_ROW_DAYS = 9999


@dataclass(frozen=True)
class Prior:
    """One look-back feature: ``kind`` is sum, max, min or last; ``value`` names a column."""

    name: str
    kind: str
    value: str


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _carries(sliced: DataFrame, key: str, day: str, row_id: str, priors: Sequence[Prior]) -> DataFrame:
    """(_slice, _key, _c_last_day, one carry per prior): what slices before hold of each slice's first key.

    One row per slice; values of kind last are wrapped, so that a NULL is told from no row.
    """
    ends = sliced.groupBy("_slice").agg(F.min(key).alias("_first"), F.max(key).alias("_end"))
    order = F.struct(day, row_id)
    totals = [
        F.max_by(F.struct(p.value), order).alias(f"_c_{p.name}") if p.kind == "last"
        else _AGGREGATES[p.kind](p.value).alias(f"_c_{p.name}")
        for p in priors
    ]
    last = (
        sliced.join(F.broadcast(ends.select("_slice", "_end")), "_slice").filter(F.col(key) == F.col("_end"))
        .groupBy("_slice", F.col("_end").alias("_key")).agg(F.max(day).alias("_c_last_day"), *totals)
    )
    wanted = ends.select("_slice", F.col("_first").alias("_key"), F.lit(True).alias("_wanted"))
    both = last.unionByName(wanted, allowMissingColumns=True)
    before = W.partitionBy("_key").orderBy("_slice").rangeBetween(W.unboundedPreceding, -1)
    names = ["_c_last_day", *[f"_c_{p.name}" for p in priors]]
    kinds = ["max", *[p.kind for p in priors]]
    return both.select(
        "_slice", "_key", "_wanted",
        *[
            (F.last(n, ignorenulls=True) if kind == "last" else _AGGREGATES[kind](n)).over(before).alias(n)
            for n, kind in zip(names, kinds)
        ],
    ).filter("_wanted").drop("_wanted")


def look_back(
    df: DataFrame,
    key: str,
    day: str,
    row_id: str,
    priors: Sequence[Prior],
    keep: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """(row_id, key, day, kept columns, last_day, each prior) over the rows before each row.

    Order is (day, row_id), which must be unique and not NULL. A row whose key is NULL
    has no past: sums are 0, the rest NULL. ``last_day`` is the day of the previous row.
    ``slices`` is the number of segments, by default that of shuffle partitions.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([row_id, key, day, *keep, *(p.value for p in priors)]))
    known = rows.filter(F.col(key).isNotNull())
    # stored, so that the border of a slice is the same for its carry and its rows
    sliced = materialize(
        known.repartitionByRange(slices, key, day, row_id).withColumn("_slice", F.spark_partition_id()), "segments"
    )
    carries = F.broadcast(_carries(sliced, key, day, row_id, priors).withColumnRenamed("_slice", "_to"))
    carried = sliced.join(carries, (F.col("_slice") == F.col("_to")) & (F.col(key) == F.col("_key")), "left")

    within = W.partitionBy("_slice", key).orderBy(day, row_id)
    before = within.rowsBetween(W.unboundedPreceding, -1)

    def prior(p: Prior) -> Column:
        carry = F.col(f"_c_{p.name}")
        if p.kind == "last":
            return F.coalesce(F.lag(F.struct(p.value)).over(within), carry)[p.value]
        here = _AGGREGATES[p.kind](p.value).over(before)
        if p.kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return (F.greatest if p.kind == "max" else F.least)(here, carry)

    past = carried.select(
        row_id, key, day, *keep,
        F.coalesce(F.lag(day).over(within), "_c_last_day").alias("last_day"),
        *[prior(p).alias(p.name) for p in priors],
    )
    no_past = rows.filter(F.col(key).isNull()).select(
        row_id, key, day, *keep,
        F.lit(None).cast(rows.schema[day].dataType).alias("last_day"),
        *[
            F.lit(0 if p.kind == "sum" else None).cast(past.schema[p.name].dataType).alias(p.name)
            for p in priors
        ],
    )
    return past.unionByName(no_past)


def entity_history(
    df: DataFrame,
    key: str,
    day: str,
    row_id: str,
    responses: Sequence[str],
    counted: Column | None = None,
) -> DataFrame:
    """Running totals of every response, row counts and days since the entity's previous row.

    ``counted`` marks the rows that enter ``<key>_cnt_train``.
    """
    marked = df.withColumns(
        {
            "_one": F.lit(1),
            "_counted": F.lit(1) if counted is None else counted.cast("int"),
        }
    )
    priors = [Prior(f"{key}_{r}_prev", "sum", r) for r in responses]
    priors += [Prior(f"{key}_cnt", "sum", "_one"), Prior(f"{key}_cnt_train", "sum", "_counted")]
    past = look_back(marked, key, day, row_id, priors)
    gap = F.coalesce(F.datediff(day, "last_day"), F.lit(FIRST_ROW_DAYS))
    return past.select(
        row_id, key, day, gap.alias(f"{key}_days"), *[p.name for p in priors]
    )


def entity_histories(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    row_id: str,
    responses: Sequence[str],
    counted: Column | None = None,
) -> DataFrame:
    """The columns of ``entity_history`` for every key, one row per row of ``df``.

    All entities are stacked under one (kind, value) key and looked back over once; one
    aggregate by row id then sets the kinds beside each other, written once. ``row_id`` must be unique.
    """
    marked = df.withColumns(
        {
            "_one": F.lit(1),
            "_counted": F.lit(1) if counted is None else counted.cast("int"),
        }
    )
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]
    )
    known = F.filter(kinds, lambda e: e["value"].isNotNull())
    stacked = marked.select(row_id, day, *responses, "_one", "_counted", F.explode(known).alias("_entity"))
    parts = {f"{r}_prev": r for r in responses} | {"cnt": "_one", "cnt_train": "_counted"}
    past = look_back(stacked, "_entity", day, row_id, [Prior(n, "sum", v) for n, v in parts.items()])
    sides = past.select(
        row_id, F.col("_entity.kind").alias("_kind"),
        F.coalesce(F.datediff(day, "last_day"), F.lit(FIRST_ROW_DAYS)).alias("days"), *parts,
    )
    # stored, and set beside each other in parts of the rows, so that disk holds the shuffle of one part
    sides = materialize(sides, "sides")
    empty = {n: F.lit(None).cast(sides.schema[n].dataType) for n in ("_kind", "days", *parts)}
    everyone = sides.unionByName(df.select(row_id, *[c.alias(n) for n, c in empty.items()]))
    blank = {"days": FIRST_ROW_DAYS} | {n: 0 for n in parts}
    columns = [
        F.coalesce(F.max(F.when(F.col("_kind") == k, F.col(n))), F.lit(v)).alias(f"{k}_{n}")
        for k in keys for n, v in blank.items()
    ]
    count = part_count(sides.count())
    wide = (everyone.filter(in_part(row_id, k, count)).groupBy(row_id).agg(*columns) for k in range(count))
    return store_parts(wide, "histories")[0]


def lag_features(
    df: DataFrame, key: str, day: str, row_id: str, value: str, gap_name: str, diff_name: str
) -> DataFrame:
    """(row_id, days since the previous row, value minus the previous row's value)."""
    past = look_back(df, key, day, row_id, [Prior("_previous", "last", value)], keep=[value])
    return past.select(
        row_id,
        F.datediff(day, "last_day").alias(gap_name),
        (F.col(value) - F.col("_previous")).alias(diff_name),
    )


def prior_extreme(
    df: DataFrame, key: str, day: str, row_id: str, value: str, kind: str, name: str
) -> DataFrame:
    """(row_id, running max or min of ``value`` over earlier rows; NULL when there is none)."""
    return look_back(df, key, day, row_id, [Prior(name, kind, value)]).select(row_id, name)
