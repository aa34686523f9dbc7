import re

import pytest

from compare import connect
from lagwise.llm import near_dedup, queries
from llm_data import assert_same_as_sql, empty_documents, odd_documents, odd_rows, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Component of every row by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    component = {i: i for i, _ in rows if i is not None}
    linked = [
        (i, j) for i, a in sets for j, b in sets
        if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    for _ in component:
        for i, j in linked:
            component[i] = component[j] = min(component[i], component[j])
    return sorted((i is not None, i or 0, len(s), component.get(i), i is None or i == component[i]) for i, s in sets)


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_matches_sql(spark, folder):
    assert_same_as_sql(queries.QUERIES["op3_near_dedup"](spark, folder), connect(folder), queries.ORACLE["op3_near_dedup"])


def test_odd_rows(spark):
    rows = odd_rows()
    assert rows_of(near_dedup.near_duplicates(odd_documents(spark))) == brute([(r[0], r[1]) for r in rows])
    kept = near_dedup.without_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3)) == [1]


def test_no_documents(spark):
    assert near_dedup.near_duplicates(empty_documents(spark)).collect() == []


@pytest.mark.parametrize("block", [3, 1024])
def test_a_chain_and_a_ring_of_edits_in_small_blocks(spark, monkeypatch, block):
    """Each text is near the one before it; the ends of the chain are far apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    words = prose(5, 120).split()
    rows = []
    for k in range(24):
        words = words[: 4 * k] + [f"new{k}x{j}" for j in range(4)] + words[4 * k + 4 :]
        rows.append((100 - k, " ".join(words)))
    rows += [(200 + k, prose(6, 100) + f" end{k}") for k in range(30)] + [(300 + k, prose(6, 100)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(near_dedup.near_duplicates(df)) == brute(rows)


def test_estimate_is_the_same_in_sql_and_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F

    random = np.random.default_rng(3)
    a = random.integers(-(1 << 63), (1 << 63) - 1, (6, 8))
    b = a.copy()
    b[1:, :3] = random.integers(-(1 << 63), (1 << 63) - 1, (5, 3))
    df = spark.createDataFrame([(k, a[k].tolist(), b[k].tolist()) for k in range(6)], "k int, a array<long>, b array<long>")
    sql = [r.e for r in df.orderBy("k").select(near_dedup.estimate(F.col("a"), F.col("b"), 128).alias("e")).collect()]
    own = [float(near_dedup.estimates(a[k].view(np.uint64), b[k : k + 1].view(np.uint64))[0]) for k in range(6)]
    assert sql == pytest.approx(own) and sql[0] == 1.0


def test_a_doc_id_with_two_texts_is_one_document(spark):
    a, b = prose(11, 90), prose(12, 90)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " end"), (4, prose(13, 90)), (3, b + " end"), (5, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
