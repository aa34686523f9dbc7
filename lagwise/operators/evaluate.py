"""Ranking quality: AUC, Gini and the lift table, without a global sort in one task.

A running total over all rows is computed slice by slice: rows are range-partitioned on the
full order, the slice number is stored, the few slice totals are prefix-summed, and each slice
then runs its own window starting from its offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.session import materialize, replace_stored

#: Rows ordered in one task.
SLICE_ROWS = 1_000_000


def running_totals(
    df: DataFrame, order: Sequence[str], totals: Mapping[str, str], slices: int | None = None
) -> DataFrame:
    """Add running sums in ``order``, including the current row; ``order`` must be unique.

    ``totals`` maps a new column to the column it sums. The number of slices follows from the
    number of rows; the slice totals are one row per slice, so the unpartitioned prefix window
    and the broadcast stay small.
    """
    ordered = None
    if slices is None:
        df, ordered = replace_stored(df, "ordered")  # counted and sliced without computing it twice
        slices = df.count() // SLICE_ROWS + 1
    sliced, _ = replace_stored(
        df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "slices", ordered
    )
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    per_slice = sliced.groupBy("_slice").agg(
        *[F.sum(source).alias(name) for name, source in totals.items()]
    )
    offsets = per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = sliced.join(F.broadcast(offsets), "_slice")
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_before_{name}") + F.sum(source).over(inside)).alias(name)
            for name, source in totals.items()
        ],
    )


def auc(df: DataFrame, score: str, y: str, slices: int | None = None) -> DataFrame:
    """One row (positives, negatives, auc); tied scores count half.

    Rows are summed per distinct score before anything is ordered.
    """
    per_score = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(score).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(y) != 1, 1)).alias("_neg"),
    )
    ranked = running_totals(per_score, [score], {"_neg_so_far": "_neg"}, slices)
    wins = F.sum(F.col("_pos") * (F.col("_neg_so_far") - F.col("_neg") * 0.5))
    return ranked.agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(wins, F.sum("_pos") * F.sum("_neg")).alias("auc"),
    )


def auc_by(df: DataFrame, groups: Sequence[str], score: str, y: str, slices: int | None = None) -> DataFrame:
    """One row (groups, positives, negatives, auc) per group; tied scores count half.

    All groups share one running total in the order (groups, score): the negatives before a group's
    first row are the least of its totals, and are taken off again. A group may hold any share of the rows.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    per_score = known.groupBy(*groups, score).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"),
        F.count(F.when(F.col(y) != 1, 1)).alias("_neg"),
    )
    ranked = running_totals(per_score, [*groups, score], {"_neg_so_far": "_neg"}, slices)
    before = F.min(F.col("_neg_so_far") - F.col("_neg"))
    wins = F.sum(F.col("_pos") * (F.col("_neg_so_far") - F.col("_neg") * 0.5)) - before * F.sum("_pos")
    return ranked.groupBy(*groups).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(wins, F.sum("_pos") * F.sum("_neg")).alias("auc"),
    )


def _gini_for(df: DataFrame, order: str, actual: Column, weight: Column, slices) -> DataFrame:
    """Gini of one ordering; equal order values share their place evenly.

    For a group of ties the result is the mean over all orders of its members, which needs
    only sums per distinct value.
    """
    per_value = (
        df.select(F.col(order), actual.alias("_a"), weight.alias("_w"))
        .groupBy(order)
        .agg(
            F.sum("_w").alias("_w"),
            F.sum(F.col("_w") * F.col("_a")).alias("_wa"),
            F.sum(F.col("_w") * F.col("_w") * F.col("_a")).alias("_wwa"),
        )
    )
    ranked = running_totals(per_value, [order], {"_wa_so_far": "_wa"}, slices)
    area = F.sum(
        F.col("_w") * (F.col("_wa_so_far") - F.col("_wa"))
        + (F.col("_w") * F.col("_wa") + F.col("_wwa")) * 0.5
    )
    return ranked.agg(
        (F.lit(1.0) - F.try_divide(area * 2, F.sum("_wa") * F.sum("_w"))).alias("gini")
    )


def gini(
    df: DataFrame, order: str, actual: str, weight: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One row (gini, max_gini, normalized_gini)."""
    w = F.lit(1.0) if weight is None else weight
    plain = _gini_for(df, order, F.col(actual), w, slices)
    best = _gini_for(df, actual, F.col(actual), w, slices)
    return plain.select(
        "gini", best.select("gini").scalar().alias("max_gini")
    ).withColumn("normalized_gini", F.try_divide("gini", "max_gini"))


def lift_table(
    df: DataFrame,
    row_id: str,
    order: str,
    pred: str,
    actual: str,
    bins: int,
    weight: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Bins of equal weight in ascending ``order`` (ties by id) with means per bin.

    The bin index rounds half to even and is limited to 1..bins.
    """
    rows = df.select(
        row_id,
        F.col(order).alias("_o"),
        F.col(pred).alias("_p"),
        F.col(actual).alias("_a"),
        (F.lit(1.0) if weight is None else weight).alias("_w"),
    )
    rows = materialize(rows, "lift")
    slices = slices or rows.count() // SLICE_ROWS + 1
    ranked = running_totals(rows, ["_o", row_id], {"_w_so_far": "_w"}, slices)
    total = rows.agg(F.sum("_w").alias("_t")).scalar()
    index = F.bround(F.col("_w_so_far") * bins / total + 0.5)
    index = F.when(index > bins, bins).when(index < 1, 1).otherwise(index).cast("int")
    w = F.sum("_w")

    def mean(column: str) -> Column:
        return F.try_divide(F.sum(F.col(column) * F.col("_w")), w)

    return (
        ranked.withColumn("pidx", index)
        .groupBy("pidx")
        .agg(
            w.alias("w"),
            F.min("_o").alias("min"),
            F.max("_o").alias("max"),
            mean("_o").alias("o"),
            mean("_p").alias("p"),
            mean("_a").alias("a"),
            F.min("_a").alias("min_a"),
            F.max("_a").alias("max_a"),
            F.sum(F.col("_a") * F.col("_w")).alias("a_cnt"),
        )
        .withColumn("err", F.try_divide("a", "p"))
    )
