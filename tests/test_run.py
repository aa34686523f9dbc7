"""Both plans end to end on the small tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from lagwise.plans import run
from lagwise.plans.queries import FIRST, SECOND
from lagwise.sources import fixtures


def test_both_plans_and_the_blend(spark, folder):
    loaded = fixtures.load(spark, folder)
    one = replace(FIRST, tree_share=0.004)
    two = replace(SECOND, tree_share=0.002)
    first_scores, second_scores, blended = run.score(loaded, one, two)
    expected = loaded.projects.filter("date_posted >= DATE '2001-01-01'").count()
    assert first_scores.count() == second_scores.count() == expected
    joined = blended.join(first_scores.withColumnRenamed("is_exciting", "a"), "projectid").join(
        second_scores.withColumnRenamed("is_exciting", "b"), "projectid"
    )
    assert joined.count() == expected
    off = F.abs(F.col("is_exciting") - (F.col("a") + F.col("b")) / 2 * F.col("discount"))
    assert joined.agg(F.max(off)).first()[0] < 1e-12
    assert blended.filter("is_exciting IS NULL OR is_exciting < 0 OR is_exciting > 1").count() == 0
