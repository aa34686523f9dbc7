import pytest
from pyspark.sql import functions as F

from lagwise.operators.evaluate import auc
from lagwise.plans import learners, text_scores
from lagwise.plans.queries import QUERIES


@pytest.fixture(scope="module")
def signal(spark):
    return spark.range(600).select(
        "id",
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 10).cast("double")).alias("x"),
        F.when(F.col("id") % 2 == 0, "a").alias("c"),
        ((F.col("id") % 10) > 4).cast("int").alias("y"),
    )


def test_impute_flags_replaces_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x DOUBLE")
    found = learners.impute_flags(df, {"x": -1}).select("x_imp", "x_missing").collect()
    assert [tuple(r) for r in found] == [(1.0, 0), (-1.0, 1), (-1.0, 1)]


def test_estimators_find_a_planted_signal(signal):
    inputs, numeric, categorical = learners.complete(signal, ["x"], ["c"], ["id", "y"])
    stages = learners.tree_inputs(numeric, categorical)
    inputs = inputs.cache()
    boosted = learners.fit(learners.boosted_trees("y", 3, 7, 0.1, 1.0, 1), stages, inputs)
    forest = learners.fit(learners.random_forest("y", 5, 2, 1, 5), stages, inputs)
    coarse = learners.fit(learners.coarse_forest("y", 5, 2, 1, 5), stages, inputs)
    ridge = learners.fit(learners.ridge_cv("y", learners.penalty_path(0.1, steps=2), 2), stages, inputs)
    scored = [
        learners.probability(boosted, inputs, "s", ["id", "y"]),
        learners.probability(forest, inputs, "s", ["id", "y"]),
        learners.regression(coarse, inputs, "s", ["id", "y"]),
        learners.probability(ridge, inputs, "s", ["id", "y"]),
    ]
    for table in scored:
        bounds = table.agg(F.min("s"), F.max("s")).first()
        assert 0.0 <= bounds[0] <= bounds[1] <= 1.0
        assert auc(table, "s", "y").first().auc > 0.85
    inputs.unpersist()


def test_penalty_path_starts_at_the_data_and_ends_at_the_ratio(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (2.0, 1.0, 1)], "a DOUBLE, flat DOUBLE, y INT")
    largest = learners.largest_penalty(df, ["a", "flat"], "y")
    assert largest == pytest.approx(500.0)
    path = learners.penalty_path(largest, 0.005, 4)
    assert len(path) == 4 and path[0] == largest and path[-1] == pytest.approx(2.5)
    assert path == sorted(path, reverse=True)


@pytest.mark.parametrize("splits, depth", [(1, 1), (3, 2), (4, 3), (6, 3), (7, 3)])
def test_split_count_becomes_depth(spark, splits, depth):
    assert learners.boosted_trees("y", 1, splits, 0.1, 0.5, 1).getMaxDepth() == depth


def test_design_matrix_drops_first_level(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "zz")], "n DOUBLE, c STRING")
    matrix, names = learners.design_matrix(df.filter("c <> 'zz'"), df, ["n"], ["c"])
    assert names == ["intercept", "n", "cb"]
    found = matrix.orderBy("n").select("x_0", "x_1", "x_2").collect()
    assert [tuple(r) for r in found] == [(1.0, 1.0, 1.0), (1.0, 2.0, 0.0), (1.0, 3.0, 0.0)]


def test_one_input_per_feature_and_more_levels_than_bins(spark):
    from lagwise.plans import first, second

    for features, kinds in ((second.MATRIX_FEATURES, set()), (first.MATRIX_FEATURES, first.CATEGORICAL)):
        df = spark.createDataFrame([(1, 0.0, *[1.0] * len(features))], ["id", "y", *features])
        _, numeric, categorical = learners.complete(df, *learners.by_kind(features, kinds), ["id", "y"])
        assert len(numeric) + len(categorical) == len(features)
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("y"), F.concat(F.lit("v"), F.col("id") % 100).alias("c"))
    inputs, numeric, categorical = learners.complete(rows, ["id"], ["c"], ["y"])
    model = learners.fit(learners.boosted_trees("y", 1, 3, 0.1, 1.0, 1), learners.tree_inputs(numeric, categorical), inputs)
    assert model.transform(inputs).count() == 300


def test_term_ids_are_dense_in_any_number_of_slices(spark):
    from lagwise.operators.tfidf import term_index

    known = spark.range(500).select(F.format_string("t%03d", F.col("id")).alias("term"), F.lit(2).alias("df")).repartition(7)
    for slices in (1, 6, None):
        found = term_index(known, slices).orderBy("term_id").collect()
        assert [(r.term, r.term_id) for r in found] == [(f"t{k:03d}", k) for k in range(500)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(120).select(
        "id",
        F.when(F.col("id") % 2 == 0, "red apple pie").otherwise("blue sky high").alias("t"),
        (F.col("id") % 2).alias("y"),
        F.when(F.col("id") < 80, "train").when(F.col("id") < 100, "validation").otherwise("test").alias("split"),
    )


def test_out_of_fold_text_scores(texts):
    field = text_scores.TextField("t", 2, 2, 5e-6)
    scored = text_scores.score_fixed_vocabulary(
        texts, "id", field, "y", F.col("split") == "train", folds=2
    ).join(texts, "id")
    assert scored.count() == 120
    assert scored.filter("pred_partial IS NULL").count() == 40
    assert scored.filter("(pred_partial > 0.5) <> (y = 1)").count() == 0
    assert scored.filter("(pred > 0.5) <> (y = 1)").count() == 0


def test_refitted_text_scores_cover_every_split_once(texts):
    field = text_scores.TextField("t", 2, 2, 5e-6)
    scored = text_scores.score_refitted_vocabulary(
        texts, "id", field, "y", "split", "s", folds=2
    ).join(texts, "id")
    assert scored.count() == 120 and scored.select("id").distinct().count() == 120
    assert scored.filter("(s > 0.5) <> (y = 1)").count() == 0


def test_documents_without_terms_get_a_zero_vector(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id INT")
    weights = spark.createDataFrame([(1, 5, 0.6), (1, 2, 0.8)], "doc INT, term_id LONG, weight DOUBLE")
    docs = docs.withColumnRenamed("id", "doc")
    found = {r.doc: r.features for r in text_scores.vectors(docs, "doc", weights, 8).collect()}
    assert found[2].numNonzeros() == 0 and found[2].size == 8 and found[1][2] == 0.8
    assert found[1].norm(2) == pytest.approx(1.0)


@pytest.mark.parametrize("name, column", [
    ("gbt_score", "pred_v1"), ("gbt_stacked", "pred_v4"), ("rf_score", "pred_day_rf"),
    ("gbt_day_score", "pred_day_gbm"), ("forest_reg_day_score", "pred_day_et"),
    ("forest_reg_score", "pred_et_v4"), ("ridge_cv_score", "pred_day_glmnet"),
    ("text_score", "pred"), ("text_score_oof", "text_tfidf"),
])
def test_model_queries_give_probabilities(spark, folder, name, column):
    scored = QUERIES[name](spark, folder)
    r = scored.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    assert r.n > 0 and 0.0 <= r.lo <= r.hi <= 1.0
