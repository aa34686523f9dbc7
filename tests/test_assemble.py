import pytest
from pyspark.sql import functions as F

from lagwise.operators import assemble, tfidf


def test_top_vendor_ties_and_null_vendor(spark):
    rows = [("p", "b", 5.0, 1.0), ("p", "a", 5.0, 9.0), ("p", None, 2.0, 3.0), ("q", None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "p STRING, v STRING, price DOUBLE, q DOUBLE")
    found = {r.p: r for r in assemble.top_vendor(df, "p", "v", F.col("price"), "q").collect()}
    assert (found["p"].v, found["p"].project_vendor_cnt, found["p"].project_vendor_quantity_rnk) == ("a", 3, 1)
    assert (found["q"].v, found["q"].vendor_cnt, found["q"].vendor_price) == (None, 2, 3.0)
    assert found["q"].vendor_average_price == pytest.approx(1.0)


def test_rollup_gives_zero_for_missing_types(spark):
    df = spark.createDataFrame([("p", "Books", 2.0), ("p", None, 3.0)], "p STRING, t STRING, a DOUBLE")
    r = assemble.conditional_rollup(
        df, "p", assemble.blank_as_other("t"), F.col("a"), {"books": "Books", "other": "Other", "trips": "Trips"}
    ).first()
    assert (r.agg_cnt, r.books_cnt, r.other_cnt, r.trips_cnt) == (2, 1, 1, 0)
    assert (r.agg_item_amount_total, r.other_item_amount_total, r.trips_item_amount_total) == (5.0, 3.0, 0.0)


def test_books_quantity_is_null_without_books_but_count_is_zero(spark):
    df = spark.createDataFrame([("p", "Trips", 2.0, 1.0), ("q", "Books", 3.0, 4.0)], "p STRING, t STRING, a DOUBLE, q DOUBLE")
    found = {r.p: (r.books_cnt, r.books_quantity) for r in assemble.resource_summary(df, "p", F.col("a"), "q", "t").collect()}
    assert found == {"p": (0, None), "q": (1, 4.0)}


def test_donor_rollup_counts_a_childless_parent_once_and_drops_null_groups(spark):
    parents = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", None)], "id STRING, g STRING")
    children = spark.createDataFrame([("p", 1, 2.0), ("p", 0, None)], "id STRING, t INT, a DOUBLE")
    found = assemble.donor_rollup(parents, children, "id", ["id", "g"], F.col("t"), "a").collect()
    assert {r.id: (r.y11, r.y12, r.y13) for r in found} == {"p": (2, 1, 2.0), "q": (1, 0, 0.0)}


def test_star_fills_only_the_named_columns(spark):
    fact = spark.createDataFrame([(1,), (2,)], "id INT")
    a = spark.createDataFrame([(1, 5)], "id INT, a INT")
    b = spark.createDataFrame([(1, 6)], "id INT, b INT")
    found = assemble.star(fact, "id", [(a, {"a": 0}), (b, None)]).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, 5, 6), (2, 0, None)]


def test_document_frequency_outside_each_fold(spark):
    docs = spark.createDataFrame([(1, "a a b", 0), (2, "a", 1), (3, "b", 1), (4, "", 1)], "id INT, t STRING, fold INT")
    counts = tfidf.term_counts(docs, "id", "t", F.split("t", " "), ["fold"])
    found = {(r.fold, r.term): r.df for r in tfidf.document_frequency_by_fold(counts, "fold", [0, 1]).collect()}
    assert {k: v for k, v in found.items() if k[1]} == {(0, "a"): 1, (0, "b"): 1, (1, "a"): 1, (1, "b"): 1}


def test_tfidf_rows_have_unit_length_and_unknown_terms_drop(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, ["c"])], "id INT, t ARRAY<STRING>")
    counts = tfidf.term_counts(docs, "id", "t", F.col("t"))
    vocabulary = tfidf.document_frequency(counts).filter("term <> 'c'")
    weights = tfidf.tfidf_weights(counts, "id", vocabulary, F.lit(3))
    lengths = {r.id: r.n for r in weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert lengths == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
