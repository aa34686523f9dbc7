import hashlib

import pytest

from compare import connect
from lagwise.llm import decontaminate as D
from lagwise.llm import queries
from llm_data import assert_same_as_sql, empty_documents, odd_documents, odd_rows, prose

ITEMS = [
    ("a", prose(1, 25)), ("b", prose(2, 14) + " other words"), ("c", "One, two."), ("d", None), ("e", "..."), ("f", "x"), (None, prose(3, 12)), ("a", prose(1, 25)),
]


def brute(text, items):
    words, hit, found = D.words_of(text), set(), set()
    for item_id, item in items:
        own = D.words_of(item)
        for at in range(max(0, len(own) - 9) if len(own) >= 10 else bool(own)):
            window = own[at : at + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add("null" if item_id is None else item_id)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_matches_sql(spark, folder):
    assert_same_as_sql(queries.QUERIES["op7_decontaminate"](spark, folder), connect(folder), queries.ORACLE["op7_decontaminate"])


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_odd_rows(spark, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = D.contaminated(odd_documents(spark, False), benchmark, block_bytes=block_bytes)
    expected = [(r[0], *brute(r[1], ITEMS)) for r in odd_rows(False)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    kept = D.without_contaminated(odd_documents(spark), benchmark)
    assert kept.columns == odd_documents(spark).columns
    assert 11 not in [r.doc_id for r in kept.collect()] and 12 in [r.doc_id for r in kept.collect()]


def test_empty_tables(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert D.contaminated(empty_documents(spark), benchmark).collect() == []
    assert not any(r.contaminated for r in D.contaminated(odd_documents(spark), benchmark.limit(0)).collect())


def test_spans_end_with_their_text_and_shares_below_one(spark):
    item = prose(8, 10)
    words = item.split()
    texts = [item, item, "before " + item + " after " + item, " ".join([*words[:5], "changed", *words[6:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([("i", item)], "item_id string, text string")
    spans = {r.doc_id: [(s.start, s.stop) for s in r["_spans"]] for r in D.find_windows(docs, benchmark).collect()}
    assert spans == {0: [(0, 10)], 1: [(0, 10)], 2: [(1, 11), (12, 22)], 3: []}
    loose = {r.doc_id: [(s.start, s.stop) for s in r["_spans"]] for r in D.find_windows(docs, benchmark, share=0.6).collect()}
    assert loose[3] == [(0, 10)]
