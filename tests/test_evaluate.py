import random

import pytest
from pyspark.sql import functions as F

from lagwise.operators.evaluate import auc, auc_by, gini, lift_table, running_totals

SCHEMA = "id BIGINT, s DOUBLE, y INT, w DOUBLE"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    return [(i, float(rng.randrange(12)) if i % 3 else 5.0, rng.randrange(2), 1.0 + i % 3) for i in range(300)]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("slices", [1, 6])
def test_running_totals_match_a_sequential_scan(df, data, slices):
    found = {r.id: r.t for r in running_totals(df, ["s", "id"], {"t": "w"}, slices).collect()}
    total, expected = 0.0, {}
    for i, s, _, w in sorted(data, key=lambda r: (r[1], r[0])):
        total += w
        expected[i] = total
    assert found == expected


@pytest.mark.parametrize("slices", [1, 6])
def test_auc_counts_all_pairs(df, data, slices):
    positive = [s for _, s, y, _ in data if y == 1]
    negative = [s for _, s, y, _ in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert auc(df, "s", "y", slices).first().auc == pytest.approx(
        wins / (len(positive) * len(negative))
    )


def test_gini_is_the_mean_over_tie_orders(df, data):
    def one(rows):
        running = area = 0.0
        for _, _, y, w in rows:
            running += w * y
            area += running * w
        return 1 - 2 * area / (sum(w * y for _, _, y, w in rows) * sum(w for *_, w in rows))

    def both(key):
        up = one(sorted(data, key=lambda r: (key(r), r[0])))
        down = one(sorted(data, key=lambda r: (key(r), -r[0])))
        return (up + down) / 2

    found = gini(df, "s", "y", F.col("w"), slices=5).first()
    assert found.gini == pytest.approx(both(lambda r: r[1]))
    assert found.max_gini == pytest.approx(both(lambda r: r[2]))
    assert found.normalized_gini == pytest.approx(found.gini / found.max_gini)


def test_lift_bins_hold_equal_weight_and_every_row(spark, df, data):
    table = lift_table(df, "id", "s", "s", "y", 10, F.col("w"), slices=5).collect()
    assert sorted(r.pidx for r in table) == list(range(1, 11))
    assert sum(r.w for r in table) == sum(w for *_, w in data)
    assert sum(r.a_cnt for r in table) == sum(w * y for _, _, y, w in data)
    assert max(r.w for r in table) < 1.7 * sum(w for *_, w in data) / 10


@pytest.mark.parametrize("slices", [1, 5])
def test_auc_of_every_group_equals_auc_of_its_rows(spark, slices):
    rows = [(i, i % 3 if i % 4 else 0, (i * 37) % 11 / 10 if i % 13 else None, None if i % 17 == 0 else i * 7 % 5 % 2) for i in range(300)]
    rows += [(900, 7, 0.5, 1), (901, 7, 0.2, 1)]
    df = spark.createDataFrame(rows, "id INT, g INT, s DOUBLE, y INT")
    found = {r.g: (r.positives, r.negatives, r.auc) for r in auc_by(df, ["g"], "s", "y", slices).collect()}
    for g, triple in found.items():
        own = [(s, y) for _, k, s, y in rows if k == g and s is not None and y is not None]
        ups, downs = [s for s, y in own if y == 1], [s for s, y in own if y != 1]
        wins = sum((a > b) + (a == b) / 2 for a in ups for b in downs)
        assert triple[:2] == (len(ups), len(downs))
        assert triple[2] == (pytest.approx(wins / (len(ups) * len(downs))) if downs else None)
    assert sorted(found) == [0, 1, 2, 7]
