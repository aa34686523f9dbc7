"""The text fit against its optimality conditions, with and without factors per scope, and beyond what a dense vector holds."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise import session
from lagwise.operators import tfidf
from lagwise.plans import learners, text_scores

ALPHA = 1e-3


def made(spark, size, seed=1, rows=40, parts=1):
    """(rows, table of vectors, the same entries dense over the few terms used)."""
    r = np.random.default_rng(seed)
    used = np.sort(r.choice(min(size, 10_000), 12, replace=False)) + (size - min(size, 10_000))
    dense = np.where(r.random((rows, 12)) < 0.4, r.random((rows, 12)), 0.0)
    y = (dense[:, 0] + 0.3 * r.random(rows) > 0.4).astype(float)
    docs = spark.createDataFrame([(k, float(y[k]), k % 4) for k in range(rows)], "_row long, _y double, part int")
    entries = [(k, int(used[j]), float(dense[k, j])) for k in range(rows) for j in range(12) if dense[k, j]]
    weights = spark.createDataFrame(entries, "_row long, term_id long, weight double")
    table = text_scores._vectors(docs.select("_row"), "_row", weights, size, "features", parts)[0]
    return docs, table, dense, y, used


def gradient(x, y, w, b):
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    return x.T @ error / len(y) + ALPHA * w, error.mean()


def best(x, y):
    w, b = np.zeros(x.shape[1]), 0.0
    one = np.c_[x, np.ones(len(y))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.r_[gradient(x, y, w, b)[0], gradient(x, y, w, b)[1]]
        h = (one * (p * (1 - p))[:, None]).T @ one / len(y) + np.diag([ALPHA] * x.shape[1] + [0.0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@pytest.mark.parametrize("size, parts", [(10_000, 1), (2**31 - 1, 3)])
def test_fit_is_the_optimum_for_any_number_of_terms(spark, size, parts):
    docs, table, dense, y, _ = made(spark, size, parts=parts)
    members = {"most": F.col("part") != 0, "some": F.col("part") == 1}
    fit = learners.TextLogistic("_y", ALPHA, 100, 1e-10)
    models = fit.fit(docs, table, "_row", "features", members, parts)
    everything = {"most": F.col("part") != 1, "some": F.lit(True)}
    found = {r._row: r.s for r in models.scored(docs, everything, "most", ["_row"], "s").collect()}
    part = np.arange(40) % 4
    for scope, fitted, asked in (("most", part != 0, part != 1), ("some", part == 1, part == 1)):
        w, b = best(dense[fitted], y[fitted])
        wanted = 1 / (1 + np.exp(-(dense @ w + b)))
        for k in np.flatnonzero(asked):
            assert found[k] == pytest.approx(wanted[k], abs=1e-4), scope
    assert len(found) == 40


def test_fit_with_factors_is_the_fit_on_scaled_rows_of_unit_length(spark):
    docs, table, dense, y, used = made(spark, 10_000, seed=2)
    factors = np.linspace(0.0, 2.0, 12)
    factors[0] = 1.5
    scales = spark.createDataFrame([(int(t), float(f)) for t, f in zip(used, factors)], "term_id long, most double")
    fit = learners.TextLogistic("_y", ALPHA, 100, 1e-10)
    models = fit.fit(docs, table, "_row", "features", {"most": F.col("part") != 0}, 1, scales)
    found = {r._row: r.s for r in models.scored(docs, {"most": F.lit(True)}, "most", ["_row"], "s").collect()}
    x = dense * factors
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    fitted = np.arange(40) % 4 != 0
    w, b = best(x[fitted], y[fitted])
    assert [found[k] for k in range(40)] == pytest.approx(list(1 / (1 + np.exp(-(x @ w + b)))), abs=1e-4)


def test_rows_without_label_are_refused(spark):
    docs, table, *_ = made(spark, 100)
    with pytest.raises(ValueError):
        learners.text_logistic("_y", ALPHA).fit(docs.withColumn("_y", F.lit(None).cast("double")), table, "_row", "features", {"all": F.lit(True)})


def test_counts_of_an_id_that_comes_twice_are_added_up(spark):
    terms = F.split("t", " ")
    once = spark.createDataFrame([(1, "b a b"), (2, "")], "doc int, t string")
    twice = once.union(spark.createDataFrame([(1, "a c"), (None, "a"), (None, "a")], "doc int, t string"))
    found = lambda docs: sorted(map(str, tfidf.term_counts(docs, "doc", "t", F.filter(terms, lambda x: x != "")).collect()))
    assert found(once) == ["Row(doc=1, term='a', tf=1)", "Row(doc=1, term='b', tf=2)"]
    assert found(twice) == [
        "Row(doc=1, term='a', tf=2)", "Row(doc=1, term='b', tf=2)", "Row(doc=1, term='c', tf=1)", "Row(doc=None, term='a', tf=2)",
    ]


def test_weights_in_parts_are_those_of_one_part(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 7).cast("string"), (F.col("id") % 3).cast("string")).alias("t"))
    counts = session.materialize(tfidf.term_counts(docs, "doc", "t", F.split("t", " ")), "counts")
    known = tfidf.document_frequency(counts, 2)
    weights = lambda: {(r.doc, r.term): r.weight for r in tfidf.tfidf_weights(counts, "doc", known, F.lit(60)).collect()}
    whole = weights()
    monkeypatch.setattr(session, "SMALL_ROWS", 1)
    assert weights() == pytest.approx(whole) and len(whole) == counts.count()


def test_no_shuffle_files_are_left_by_a_stored_step(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    left = lambda: sum(1 for folder in folders for _ in Path(folder.getPath()).rglob("shuffle_*.data"))
    before = left()
    session.materialize(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count(), "step")
    assert left() <= before
