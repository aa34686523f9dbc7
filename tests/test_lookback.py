import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagwise.operators.lookback import (
    Prior,
    entity_history,
    lag_features,
    look_back,
    prior_extreme,
)

SCHEMA = "id BIGINT, k STRING, day DATE, y INT, price DOUBLE"


def d(month, day):
    return dt.date(2020, month, day)


@pytest.fixture(scope="module")
def hand(spark):
    rows = [
        (1, "A", d(1, 1), 1, 10.0),
        (2, "A", d(1, 1), 0, None),
        (3, "A", d(1, 5), 1, 7.0),
        (4, None, d(1, 2), 1, 5.0),
        (5, None, d(1, 3), 1, 6.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, *names):
    return {r["id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_hand_worked_history(hand):
    history = entity_history(hand, "k", "day", "id", ["y"], F.col("day") < d(1, 5))
    assert by_id(history, "k_days", "k_y_prev", "k_cnt", "k_cnt_train") == {
        1: (9999, 0, 0, 0),
        2: (0, 1, 1, 1),
        3: (4, 1, 2, 2),
        4: (9999, 0, 0, 0),
        5: (9999, 0, 0, 0),
    }


def test_lags_use_the_directly_preceding_row(hand):
    lags = lag_features(hand, "k", "day", "id", "price", "gap", "diff")
    assert by_id(lags, "gap", "diff") == {
        1: (None, None), 2: (0, None), 3: (4, None), 4: (None, None), 5: (None, None),
    }


def test_extremes_skip_missing_values(hand):
    highest = prior_extreme(hand, "k", "day", "id", "price", "max", "top")
    assert by_id(highest, "top") == {1: (None,), 2: (10.0,), 3: (10.0,), 4: (None,), 5: (None,)}


def _random_rows(seed, rows=400):
    rng = random.Random(seed)
    result = []
    for i in range(rows):
        key = None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}"
        price = None if rng.random() < 0.1 else float(rng.randrange(100))
        result.append((i, key, d(1, 1 + rng.randrange(28)), rng.randrange(2), price))
    return result


def _brute(rows):
    expected = {}
    for i, key, day, _, _ in rows:
        past = [] if key is None else sorted(
            (r for r in rows if r[1] == key and (r[2], r[0]) < (day, i)),
            key=lambda r: (r[2], r[0]),
        )
        prices = [r[4] for r in past if r[4] is not None]
        expected[i] = (
            sum(r[3] for r in past),
            max(prices, default=None),
            min(prices, default=None),
            past[-1][4] if past else None,
            past[-1][2] if past else None,
        )
    return expected


PRIORS = [
    Prior("s", "sum", "y"), Prior("hi", "max", "price"), Prior("lo", "min", "price"),
    Prior("prev", "last", "price"),
]


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force_under_any_partitioning(spark, partitions):
    rows = _random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = by_id(look_back(df, "k", "day", "id", PRIORS), "s", "hi", "lo", "prev", "last_day")
    assert found == _brute(rows)


def test_a_later_label_never_reaches_an_earlier_row(spark):
    rows = _random_rows(5)
    cut = d(1, 15)
    changed = [(i, k, day, 1 - y if day >= cut else y, p) for i, k, day, y, p in rows]
    one = by_id(entity_history(spark.createDataFrame(rows, SCHEMA), "k", "day", "id", ["y"]), "k_y_prev", "day")
    two = by_id(entity_history(spark.createDataFrame(changed, SCHEMA), "k", "day", "id", ["y"]), "k_y_prev", "day")
    early = {i for i, values in one.items() if values[1] < cut}
    assert early and all(one[i] == two[i] for i in early)


def test_no_window_or_shuffle_gathers_an_entity(spark):
    """Windows over rows run per (slice, entity); only the carries, two rows a slice, meet by entity."""
    df = spark.range(10).selectExpr(
        "id", "cast(id % 2 as string) k", "date_add(date'2020-01-01', int(id)) day", "1 y"
    )
    plan = entity_history(df, "k", "day", "id", ["y"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [w for w in windows if "windowspecdefinition(_slice#" in w]
    over_carries = [w for w in windows if "windowspecdefinition(_key#" in w]
    assert over_rows and over_carries and len(windows) == len(over_rows) + len(over_carries)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("hashpartitioning(k#" in line for line in exchanges)


@pytest.mark.parametrize("slices", [1, 2, 9, 40])
def test_hot_entity_day_is_cut_into_slices(spark, slices):
    """Nine rows of ten are one entity on one day; the slices of its rows are carried over."""
    rng = random.Random(slices)
    rows = []
    for i in rng.sample(range(1000), 300):
        hot = rng.random() < 0.9
        price = None if rng.random() < 0.3 else float(rng.randrange(100))
        rows.append((i, "hot" if hot else rng.choice(["a", "z", None]), d(1, 9) if hot else d(1, rng.choice([1, 9, 20])), 1, price))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = by_id(look_back(df, "k", "day", "id", PRIORS, slices=slices), "s", "hi", "lo", "prev", "last_day")
    assert found == _brute(rows)


def test_all_entities_at_once_equal_one_by_one(spark):
    from lagwise.operators.lookback import entity_histories

    rows = [(i, None if i % 11 == 0 else i % 4, "a" if i % 10 else None, i // 25, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id LONG, k INT, c STRING, n INT, y INT").selectExpr(
        "id", "k", "c", "date_add(DATE'2020-01-01', n) AS day", "y"
    )
    together = {r.id: r for r in entity_histories(df, ["k", "c"], "day", "id", ["y"], F.col("id") < 150).collect()}
    assert len(together) == 200
    for key in ("k", "c"):
        alone = entity_history(df, key, "day", "id", ["y"], F.col("id") < 150)
        for r in alone.collect():
            for name in (f"{key}_days", f"{key}_y_prev", f"{key}_cnt", f"{key}_cnt_train"):
                assert together[r.id][name] == r[name]
