"""Blend of both plans into the final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_score(first: Column, second: Column, discount: Column) -> Column:
    """(half of each plan's score) times the time discount."""
    return (F.lit(0.5) * first + F.lit(0.5) * second) * discount


def final_blend(first: DataFrame, second: DataFrame) -> DataFrame:
    """(projectid, is_exciting) for projects scored by both plans."""
    left = first.select("projectid", F.col("is_exciting").alias("_first"), "discount")
    right = second.select("projectid", F.col("is_exciting").alias("_second"))
    return left.join(right, "projectid", "inner").select(
        "projectid",
        final_score(F.col("_first"), F.col("_second"), F.col("discount")).alias("is_exciting"),
    )
