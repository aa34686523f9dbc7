"""Steps on the way to a stored table go with it, and parts give the table that is made at once."""

from pathlib import Path

from pyspark.sql import functions as F

from lagwise import session
from lagwise.operators import lookback


def steps(spark):
    return {p.name for p in Path(session.shared_folder(spark).removeprefix("file://")).rglob("step-*")}


def test_a_settled_table_keeps_no_step_but_its_own(spark):
    before = steps(spark)
    made = session.settled(lambda: session.materialize(session.materialize(spark.range(9), "step").filter("id > 2"), "step"), "step")
    assert made.count() == 6 and len(steps(spark) - before) == 1


def test_a_settled_table_in_parts_is_whole(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_ROWS", 1)
    wide = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("k"), *[F.col("id").alias(f"c{n}") for n in range(30)])
    made = session.settled(lambda: wide, "step", "k", 500)
    assert sorted(r.c0 for r in made.collect()) == list(range(500))


def test_histories_in_parts(spark, monkeypatch):
    rows = spark.range(300).select(
        "id", F.expr("date_add(date'2020-01-01', cast(id % 40 as int))").alias("day"), (F.col("id") % 7).alias("a"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("y"),
    )
    found = lambda: sorted(map(tuple, lookback.entity_histories(rows, ["a", "b"], "day", "id", ["y"]).collect()))
    whole = found()
    monkeypatch.setattr(session, "SMALL_ROWS", 1)
    assert found() == whole and len(whole) == 300
