import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagwise.operators import calendar
from lagwise.operators.curve import attach_factor, maturity_curve


def d(day):
    return dt.date(2020, 1, day)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "A", d(1)), (2, "A", d(1)), (3, "A", d(5)), (4, None, d(1)), (5, None, d(3))]
    return spark.createDataFrame(data, "id BIGINT, k STRING, day DATE")


def test_neighbours_count_both_directions_and_null_is_a_group(rows):
    counts = calendar.neighbour_counts(
        rows, "k", "day", {"wk": (-3, 3), "bwk": (-6, 6)}, "mth", {"p2": 2, "same": 0}
    )
    found = calendar.attach_by_day(rows, counts, ["k"], "day").orderBy("id").collect()
    assert [(r.wk, r.bwk, r.mth, r.p2, r.same) for r in found] == [
        (2, 3, 3, 0, 2), (2, 3, 3, 0, 2), (1, 3, 3, 0, 1), (2, 2, 2, 1, 1), (2, 2, 2, 0, 1),
    ]


def test_total_before_day_leaves_the_whole_day_out(rows):
    daily = calendar.day_profile(rows, ["k"], "day", n=F.count(F.lit(1)))
    before = calendar.total_before_day(daily, "k", "day", "n", "t")
    found = {(r.k, r.day): r.t for r in before.collect()}
    assert found == {("A", d(1)): 0, ("A", d(5)): 2, (None, d(1)): 0, (None, d(3)): 1}


def test_trailing_rate_waits_for_a_full_frame_and_skips_today(spark):
    data = [(d(i), float(i)) for i in range(1, 6)]
    df = spark.createDataFrame(data, "day DATE, score DOUBLE")
    found = calendar.trailing_rate(df, "day", "score", {"m3": 3}).orderBy("day").collect()
    assert [r.m3 for r in found] == [None, None, None, 2.0, 3.0]


def test_daily_mean_is_null_when_a_score_is_missing(spark):
    df = spark.createDataFrame([(d(1), 1.0), (d(1), None), (d(2), 3.0)], "day DATE, s DOUBLE")
    found = {r.day: (r.pred_mean, r.days_to_end) for r in calendar.daily_mean(df, "day", "s", d(11)).collect()}
    assert found == {d(1): (None, 10), d(2): (3.0, 9)}


def test_curve_is_normalised_and_unknown_ages_keep_null(spark):
    cohort = spark.createDataFrame(
        [(0, 1), (0, 0), (2, 0), (2, 0), (500, 1), (-1, 1), (None, 1)], "age INT, y INT"
    )
    curve = maturity_curve(cohort, "age", "y")
    found = {r.age: round(r.factor, 6) for r in curve.collect()}
    assert found == {0: 1.0, 2: 0.5}
    rows = spark.createDataFrame([(1, 2), (2, 3)], "id INT, since INT")
    looked_up = {r.id: r.factor for r in attach_factor(rows, "since", curve, "age").collect()}
    assert looked_up == {1: 0.5, 2: None}
