"""Keeping a table's own columns clear of the names that an operator works with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns of these names renamed, and a function that gives them their names back."""
    taken, wanted = {c.lower() for c in df.columns}, {n.lower() for n in names}
    away = {}
    for column in df.columns:
        if column.lower() in wanted:
            free = f"{column}_aside"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            away[column] = free
    if not away:
        return df, lambda out: out
    return df.withColumnsRenamed(away), lambda out: out.withColumnsRenamed({v: k for k, v in away.items()})
