"""Roll-ups of one-to-many tables, deduplication and star assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.functions.scalars import label_blank
from lagwise.operators.lookup import lookup_join, small_key_sets


def keep_first(df: DataFrame, key: Column, key_name: str, position: str) -> DataFrame:
    """Row with the smallest ``position`` per key; copies collapse before the shuffle."""
    return _keep_one(df, key, key_name, position, F.min_by)


def keep_last(df: DataFrame, key: Column, key_name: str, position: str) -> DataFrame:
    """Row with the largest ``position`` per key; copies collapse before the shuffle."""
    return _keep_one(df, key, key_name, position, F.max_by)


def _keep_one(df, key, key_name, position, pick) -> DataFrame:
    kept = [c for c in df.columns if c != key_name]
    return (
        df.withColumn("_key", key)
        .groupBy("_key")
        .agg(pick(F.struct(*kept), F.col(position)).alias("_row"))
        .select(F.col("_key").alias(key_name), "_row.*")
    )


def conditional_rollup(
    df: DataFrame,
    key: str,
    category: Column,
    amount: Column,
    types: Mapping[str, str],
    overall: str = "agg",
) -> DataFrame:
    """Count and amount per key, overall and for each category value, in one aggregation.

    ``types`` maps an output prefix to a category value. A key without rows of a type gets 0.
    """
    tagged = df.select(key, category.alias("_type"), amount.alias("_amount"))
    columns = [
        F.count(F.lit(1)).alias(f"{overall}_cnt"),
        F.coalesce(F.sum("_amount"), F.lit(0.0)).alias(f"{overall}_item_amount_total"),
    ]
    for prefix, value in types.items():
        hit = F.col("_type") == value
        columns.append(F.count(F.when(hit, 1)).alias(f"{prefix}_cnt"))
        columns.append(
            F.coalesce(F.sum(F.when(hit, F.col("_amount"))), F.lit(0.0)).alias(
                f"{prefix}_item_amount_total"
            )
        )
    return tagged.groupBy(key).agg(*columns)


def resource_summary(
    df: DataFrame, key: str, price: Column, quantity: str, category: str, books: str = "Books"
) -> DataFrame:
    """Rows, price and quantity per key, plus rows and quantity of one category.

    Sums over no known value are 0, except the category quantity, which stays NULL when the
    key has no row of that category.
    """
    is_book = F.col(category) == books
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("resource_cnt"),
        F.coalesce(F.sum(price), F.lit(0.0)).alias("resource_price"),
        F.coalesce(F.sum(quantity), F.lit(0.0)).alias("resource_quantity"),
        F.count(F.when(is_book, 1)).alias("books_cnt"),
        F.when(
            F.count(F.when(is_book, 1)) > 0,
            F.coalesce(F.sum(F.when(is_book, F.col(quantity))), F.lit(0.0)),
        ).alias("books_quantity"),
    )


def top_vendor(
    df: DataFrame, key: str, vendor: str, price: Column, quantity: str
) -> DataFrame:
    """The vendor with the largest price per key, its totals and its overall averages.

    The rank windows see one row per (key, vendor), never raw rows. Equal totals rank by
    vendor, NULL first. NULL is a vendor of its own.
    """
    priced = df.select(key, vendor, price.alias("_price"), F.col(quantity).alias("_quantity"))

    def totals(prefix: str) -> list[Column]:
        return [
            F.coalesce(F.sum("_price"), F.lit(0.0)).alias(f"{prefix}_price"),
            F.coalesce(F.sum("_quantity"), F.lit(0.0)).alias(f"{prefix}_quantity"),
        ]

    pairs = priced.groupBy(key, vendor).agg(*totals("project_vendor"))
    of_key = W.partitionBy(key)

    def rank(column: str) -> Column:
        order = of_key.orderBy(F.col(column).desc(), F.col(vendor).asc_nulls_first())
        return F.row_number().over(order).cast("int")

    ranked = pairs.withColumns(
        {
            "project_vendor_cnt": F.count(F.lit(1)).over(of_key),
            "project_vendor_price_rnk": rank("project_vendor_price"),
            "project_vendor_quantity_rnk": rank("project_vendor_quantity"),
        }
    )
    best = ranked.filter(F.col("project_vendor_price_rnk") == 1)
    vendors = priced.groupBy(vendor).agg(
        F.count(F.lit(1)).alias("vendor_cnt"), *totals("vendor")
    ).withColumn("vendor_average_price", F.try_divide("vendor_price", "vendor_quantity"))
    (small,) = small_key_sets(df, [[vendor]])
    return lookup_join(
        best, vendors.withColumn("_rows", F.col("vendor_cnt")), [vendor], key, "_rows", small
    )


def donor_rollup(
    parents: DataFrame,
    children: DataFrame,
    on: str,
    group: Sequence[str],
    teacher_flag: Column,
    amount: str,
) -> DataFrame:
    """(group, y11, y12, y13): rows, teacher gifts and amount per parent.

    The join keeps parents without children, which count as one row with amount 0. Parents
    with a NULL in any group column are left out. Children are summed before the join.
    """
    per_parent = children.groupBy(on).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(teacher_flag).alias("_teacher"),
        F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("_amount"),
    )
    joined = parents.select(*group).dropna(subset=list(group)).join(per_parent, on, "left")
    return joined.groupBy(*group).agg(
        F.sum(F.coalesce("_rows", F.lit(1))).alias("y11"),
        F.sum(F.coalesce("_teacher", F.lit(0))).alias("y12"),
        F.sum(F.coalesce("_amount", F.lit(0.0))).alias("y13"),
    )


def star(fact: DataFrame, on: str, sides: Sequence[tuple[DataFrame, Mapping | None]]) -> DataFrame:
    """Left join every side on ``on`` and fill the named columns of each side.

    All joins share one key, so the fact side is shuffled once. The fills are applied in a
    single projection at the end.
    """
    fills: dict = {}
    joined = fact
    for side, fill in sides:
        joined = joined.join(side, on, "left")
        fills.update(fill or {})
    return joined.fillna(fills) if fills else joined


def blank_as_other(category: str, label: str = "Other") -> Column:
    return label_blank(F.col(category), label)
