import pytest

from compare import connect
from lagwise.llm import line_runs as L
from lagwise.llm import queries
from llm_data import assert_same_as_sql, empty_documents, odd_documents, odd_rows

UPPER = str.maketrans(L.UPPER, L.UPPER.lower())


def brute(texts, min_docs, min_chars=1):
    keyed = [[line.strip(L.BLANKS).translate(UPPER) for line in (t or "").split("\n")] for t in texts]
    counts = {}
    for keys in keyed:
        for key in set(keys):
            counts[key] = counts.get(key, 0) + (len(key) >= min_chars)
    out = []
    for text, keys in zip(texts, keyed):
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, keys) if counts[key] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def made_up(documents):
    """Every line k stands in about documents / (k + 1) texts; some twice in one text."""
    texts = []
    for d in range(documents):
        lines = [f" Line {k}\t" if d % 2 else f"line {k}" for k in range(12) if d % (k + 1) == 0]
        texts.append("\n".join([f"own {d}", *lines, "", *lines[:1], "É" if d % 3 else "é", "\x0b"]))
    return texts


def test_matches_sql(spark, folder):
    assert_same_as_sql(queries.QUERIES["op12_line_runs"](spark, folder), connect(folder), queries.ORACLE["op12_line_runs"])


@pytest.mark.parametrize("batches,small", [(1, True), (5, None), (4, False)])
def test_brute_force(spark, batches, small):
    texts = made_up(40) + [None, "", " ", "own 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    common = L.common_lines(docs, min_docs=10, batches=batches)
    rows = L.without_lines(docs, common, small=small).orderBy("doc_id").collect()
    assert [(r.kept_text, r.n_lines, r.n_dropped) for r in rows] == brute(texts, 10)


@pytest.mark.parametrize("fanout", [2, 3])
def test_levels_keep_all_counts_and_settled_keys_are_not_added_again(spark, fanout):
    texts = made_up(60)
    runs = L.LineRuns(spark, min_docs=8, fanout=fanout, buckets=3)
    sizes = []
    for at in range(0, 60, 10):
        batch = spark.createDataFrame([(t,) for t in texts[at : at + 10]], "text string")
        lines = L.line_hashes(batch)
        counts = lines.groupBy(*L.KEY).count()
        sizes.append((counts.count(), runs.unsettled(counts).count()))
        runs.add(lines)
        assert all(len(level) < fanout for level in runs.levels)
    assert sizes[0][0] == sizes[0][1] and sizes[-1][1] < sizes[-1][0]
    plan = runs.unsettled(L.line_hashes(spark.createDataFrame([("a",)], "text string")).groupBy(*L.KEY).count())
    with_merge = plan.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert with_merge.count("Exchange hashpartitioning") <= 1  # the batch's own counts; no run moves
    all_keys = L.line_hashes(spark.createDataFrame([(t,) for t in texts], "text string")).groupBy(*L.KEY).count()
    expected = {tuple(r)[:2] for r in all_keys.where("count >= 8").collect()}
    assert {tuple(r)[:2] for r in runs.common().collect()} == expected
    runs.close()
    assert runs.common().count() == 0


def test_odd_rows_and_own_columns(spark):
    docs = odd_documents(spark)
    for name in ("_lines", "_r1", "n_dropped", "kept_text"):
        docs = docs.withColumn(name, docs.slot)
    kept = L.without_common_lines(docs, min_docs=3, batches=2)
    assert kept.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    expected = brute([r[1] for r in odd_rows()], 3)
    assert sorted(tuple(r)[-3:] for r in kept.collect()) == sorted(expected)
    assert {tuple(r)[-7] for r in kept.collect()} == {1}


def test_empty_table(spark):
    assert L.without_common_lines(empty_documents(spark), 10).collect() == []
