import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lagwise.functions import dates, scalars, text
from lagwise.operators.splits import training_mask


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_clamp_keeps_null(spark):
    values = [None, -1.0, 0.1, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    found = [r.c for r in df.orderBy("i").select(scalars.clamp(F.col("v"), 0.0, 0.25).alias("c")).collect()]
    assert found == [None, 0.0, 0.1, 0.25]


def test_three_flag_rules(spark):
    df = spark.createDataFrame([("t",), ("f",), ("x",), (None,)], "v STRING")
    found = df.select(
        scalars.flag_or_zero(F.col("v")), scalars.flag_strict(F.col("v")),
        scalars.flag_keep_null(F.col("v")),
    ).collect()
    assert [tuple(r) for r in found] == [(1, 1, 1), (0, 0, 0), (0, None, 0), (0, None, None)]


def test_ordinal_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("z",)], "v STRING")
    found = df.select(scalars.ordinal(F.col("v"), ["a", "b"], blank=0).alias("c")).collect()
    assert [r.c for r in found] == [2, 1, 0, 0, None]


def test_rates_without_division_by_zero(spark):
    r = one(
        spark,
        a=scalars.prior_rate(F.lit(3), F.lit(0)),
        b=scalars.prior_rate(F.lit(3), F.lit(4)),
        c=scalars.credibility_rate(F.lit(3), F.lit(4), F.lit(0.5), 10),
    )
    assert (r.a, r.b) == (0.0, 0.75)
    assert r.c == pytest.approx(8 / 14)


def test_folds_cover_their_range_and_ignore_partitioning(spark):
    def folds(df):
        u = scalars.uniform_from_id(F.col("id"), "x")
        rows = df.select("id", u.alias("u"), scalars.even_fold(u, 10).alias("a"),
                         scalars.descending_fold(u, 10).alias("b")).collect()
        return {r.id: (r.u, r.a, r.b) for r in rows}

    one_way, other = folds(spark.range(2000)), folds(spark.range(2000).repartition(9))
    assert one_way == other
    assert {a for _, a, _ in one_way.values()} == set(range(10))
    assert {b for _, _, b in one_way.values()} == set(range(1, 11))
    assert 0.45 < sum(u for u, _, _ in one_way.values()) / 2000 < 0.55


def test_first_scored(spark):
    df = spark.createDataFrame([(0.0, 0.3), (None, 0.3), (0.7, 0.3)], "p DOUBLE, f DOUBLE")
    found = df.select(scalars.first_scored(F.col("p"), F.col("f")).alias("a"),
                      scalars.first_scored(F.col("p"), F.col("f"), False).alias("b")).collect()
    assert [tuple(r) for r in found] == [(0.3, 0.0), (0.3, 0.3), (0.7, 0.7)]


def test_time_discount_ends(spark):
    end = dt.date(2014, 5, 12)
    r = one(
        spark,
        last=dates.time_discount(F.lit(end), end),
        first=dates.time_discount(F.lit(end - dt.timedelta(131)), end),
    )
    assert r.last == 0.5 and r.first == pytest.approx(1.0)


def test_split_latest_cut_wins(spark):
    cuts = [(None, "none"), (dt.date(2010, 4, 1), "train"), (dt.date(2013, 1, 1), "val"), (dt.date(2014, 1, 1), "test")]
    days = [dt.date(2010, 3, 31), dt.date(2010, 4, 1), dt.date(2013, 1, 1), dt.date(2014, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    assert [r.s for r in df.select(dates.split_by_date(F.col("d"), cuts).alias("s")).collect()] == [
        "none", "train", "val", "test"]


def test_masks(spark):
    df = spark.createDataFrame([("train", 1), ("val", 1), ("train", 0), ("test", 1)], "split STRING, g INT")
    found = df.select(training_mask("split"), training_mask("split", True, ["g"])).collect()
    assert [tuple(r) for r in found] == [(True, True), (False, True), (True, False), (False, False)]


def test_logs_of_non_positive_values_are_null(spark):
    r = one(spark, a=scalars.log_offset(F.lit(0.0)), b=scalars.log_offset(F.lit(-1.0), 2))
    assert r.a is None and r.b == pytest.approx(math.log(1))


CLEAN = [
    (r"Hi\nthere\t it's  -- ok!", "Hi there it's ok"),
    ("", ""), (None, ""), ("  a\n\nb\u00e9c ", "a b c"), (r"\\n\tx", "x"),
]


@pytest.mark.parametrize("raw, cleaned", CLEAN)
def test_clean(spark, raw, cleaned):
    assert one(spark, c=text.clean_text(F.lit(raw).cast("string"))).c == cleaned


def test_clean_survives_a_long_run_of_unwanted_characters(spark):
    raw = "a" + "-" * 200000 + "B"
    assert one(spark, c=text.clean_text(F.lit(raw), lower=True)).c == "a b"


def test_word_counts(spark):
    r = one(spark, a=text.word_count(F.lit("")), b=text.word_count(F.lit("  a  b c ")),
            c=text.word_count(F.lit(None).cast("string")))
    assert tuple(r) == (0, 3, 0)


def test_tokens(spark):
    r = one(
        spark,
        rich=text.rich_tokens(F.lit("It's 50% off (now)! Don't")),
        letters=text.letter_tokens(F.lit("\u00c9cole na\u00efve e\u0301t\u00e9 x2y")),
    )
    assert r.rich == ["it's", "50", "off", "now", "don't"]
    assert r.letters == ["ecole", "naive", "ete", "x", "y"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t ARRAY<STRING>")
    found = [r.g for r in df.select(text.ngrams(F.col("t"), 3).alias("g")).collect()]
    assert found == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_strip_nul_and_newlines(spark):
    assert one(spark, c=text.strip_nul(F.lit("a\u0000b\r\nc\rd"))).c == "ab\nc\nd"
