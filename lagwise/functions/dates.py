"""Calendar expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(day: Column) -> Column:
    """Days since the epoch, for range frames counted in whole days."""
    return F.unix_date(day)


def year_month(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def days_after(day: Column, reference: dt.date) -> Column:
    return F.datediff(day, F.lit(reference))


def log_days_after(day: Column, reference: dt.date) -> Column:
    """ln(days + 1); NULL on and before the day preceding the reference."""
    elapsed = days_after(day, reference)
    return F.when(elapsed > -1, F.log1p(elapsed.cast("double")))


def split_by_date(day: Column, cuts: Sequence[tuple[dt.date | None, str]]) -> Column:
    """Label of the latest cut that starts on or before ``day``.

    ``cuts`` are (start, label) pairs; the start None labels everything earlier.
    """
    earliest = [label for start, label in cuts if start is None]
    dated = sorted(((s, l) for s, l in cuts if s is not None), reverse=True)
    start, label = dated[0]
    chain = F.when(day >= F.lit(start), F.lit(label))
    for start, label in dated[1:]:
        chain = chain.when(day >= F.lit(start), F.lit(label))
    return chain.otherwise(F.lit(earliest[0] if earliest else None))


def time_discount(day: Column, end: dt.date, floor: float = 0.5, span: int = 131) -> Column:
    """Linear in age: ``floor`` on the last day, 1.0 at ``span`` days before it."""
    return F.datediff(F.lit(end), day) * F.lit((1.0 - floor) / span) + F.lit(floor)
