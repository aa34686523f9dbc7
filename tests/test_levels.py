"""Level codes and design rows against hand-worked and brute-force values."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from lagwise.operators import levels, lookup
from lagwise.plans import learners, text_scores

ROWS = [
    (1, "b", None, 2.0), (2, "a", "x", 0.0), (3, "", "x", None), (4, None, "y", 5.0), (5, "b", "z", -1.0),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, kind string, other string, size_ double")


@pytest.mark.parametrize("limit", [50_000, 0])  # broadcast whole, and hot levels apart
def test_codes_are_dense_per_column(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(levels, "BROADCAST_KEYS", limit)
    codes = levels.level_codes(rows.filter("id < 5"), ["kind", "other"], slices=3)
    assert sorted(map(tuple, codes.collect())) == [
        ("kind", "", 1, 1), ("kind", "a", 2, 1), ("kind", "b", 3, 1), ("other", "x", 1, 2), ("other", "y", 2, 1),
    ]
    found = {r["id"]: (r["kind_code"], r["other_code"]) for r in levels.coded(rows, "id", ["kind", "other"], codes).collect()}
    assert found == {1: (3, None), 2: (2, 1), 3: (1, 1), 4: (None, 2), 5: (3, None)}


@pytest.mark.parametrize("limit", [50_000, 0])
def test_design_rows(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(levels, "BROADCAST_KEYS", limit)
    codes = levels.level_codes(rows, ["kind", "other"])
    made = levels.design_rows(rows, "id", ["size_", "kind", "other"], ["kind", "other"], codes)
    found = {r["id"]: (r["size"], r["indices"], r["values"]) for r in made.collect()}
    assert found == {
        1: (6, [0, 1, 3], [1.0, 2.0, 1.0]), 2: (6, [0, 2], [1.0, 1.0]), 3: (6, [0], [1.0]),
        4: (6, [0, 1, 4], [1.0, 5.0, 1.0]), 5: (6, [0, 1, 3, 5], [1.0, -1.0, 1.0, 1.0]),
    }
    stored = learners.stored_vectors(made.filter("id = 5"), "features").first()["features"]
    assert stored == SparseVector(6, [0, 1, 3, 5], [1.0, -1.0, 1.0, 1.0])


def test_no_rows(spark, rows):
    codes = levels.level_codes(rows.limit(0), ["kind"])
    assert codes.count() == 0
    assert {r["kind_code"] for r in levels.coded(rows, "id", ["kind"], codes).collect()} == {None}
    assert levels.design_rows(rows.limit(0), "id", ["kind"], ["kind"], codes).count() == 0


def test_a_hundred_thousand_levels_with_a_hot_one(spark):
    many = spark.range(150_000).select(
        "id", F.when(F.col("id") < 50_000, F.lit("hot")).otherwise(F.lpad(F.col("id").cast("string"), 7, "0")).alias("k")
    )
    codes = levels.level_codes(many, ["k"])
    assert codes.count() == 100_001 > lookup.BROADCAST_KEYS
    made = levels.design_rows(many, "id", ["k"], ["k"], codes)
    wrong = made.filter(
        F.when(F.col("id") < 50_000, F.col("indices")[1] != 100_000)
        .when(F.col("id") == 50_000, F.size("indices") != 1)
        .otherwise(F.col("indices")[1] != F.col("id") - 50_000)
    )
    assert made.count() == 150_000
    assert wrong.count() == 0
    assert made.first()["size"] == 100_001


def test_scaled_counts_are_unit_tfidf(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc long")
    weights = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "doc long, term_id long, weight double")
    table = text_scores.vectors(docs, "doc", weights, 3, "_counts")
    scale = np.array([2.0, 0.0, 1.0])
    found = {r["doc"]: r["features"].toArray().tolist() for r in text_scores.scaled(table, scale).collect()}
    assert found == {1: [2 / 8**0.5, 0.0, 2 / 8**0.5], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 0.0]}


def test_scope_scale_is_the_smooth_idf(spark):
    table = spark.createDataFrame([(1, 3), (0, 1)], "term_id long, df long")
    assert text_scores.scope_scale(table, "df", 5, 2, 2) == pytest.approx([0.0, np.log(6 / 4) + 1])


def test_vocabulary_beyond_a_vector_is_refused(spark):
    docs = spark.createDataFrame([(1,)], "doc long")
    with pytest.raises(ValueError, match="terms"):
        text_scores.vectors(docs, "doc", docs.selectExpr("doc", "doc AS term_id", "1.0D AS weight"), 2**31)
