import hashlib

import numpy as np
import pytest

from lagwise.llm import queries, syncmers as S
from llm_data import LONG, empty_documents, odd_documents, odd_rows, prose


def brute_anchors(text):
    """Places of k-mers whose least inner s-mer is at an edge, by the hashes of single s-mers."""
    def smer(t):
        return int(S.anchors(t + "\0" * 0)[1][0]) if len(t) < S.K else None

    def value(t):
        codes = np.array([ord(c) for c in t], dtype=np.uint64) * S._CODE + np.uint64(1)
        powers, _ = S.W._power_tables(len(t))
        return int(S.W.mix(np.array([np.sum(codes * powers[: len(t)], dtype=np.uint64)]))[0])

    places = []
    for at in range(len(text) - S.K + 1):
        values = [value(text[at + k : at + k + S.S]) for k in range(S.K - S.S + 1)]
        if min(values) in (values[0], values[-1]):
            places.append(at)
    return places


@pytest.mark.parametrize("text", [prose(1, 30), "aaaaaaaaaaaaaaaaaaaa", "日本語のテキストをここに置きますとても", prose(2, 3)])
def test_anchors_are_closed_syncmers(text):
    assert S.anchors(text)[0].tolist() == brute_anchors(text)


def test_anchors_move_with_the_text():
    text = prose(3, 200)
    pairs = S.match(text, "inserted at the front " + text)
    assert len(pairs) > 100 and set(pairs[:, 1] - pairs[:, 0]) == {22}


def longest_chain(places):
    best = []
    for k, p in enumerate(places):
        best.append(1 + max((best[m] for m in range(k) if places[m] < p), default=0))
    return max(best, default=0)


def first_places(text):
    """Position of the first anchor of each hash (32 bits)."""
    at, hashes = S.anchors(text)
    out = {}
    for place, value in zip(at.tolist(), (hashes >> np.uint64(32)).tolist()):
        out.setdefault(value, place)
    return out


@pytest.mark.parametrize("one,other", [(1, 1), (20, 30), (5, 60), (60, 60), (2, 3)])
def test_likeness_is_the_longest_common_chain(one, other):
    words = prose(7, 60).split()
    a, b = " ".join(words[:one]), " ".join(words[30:other] + words[:30])
    first, second = first_places(a), first_places(b)
    common = longest_chain([second[h] for h in sorted(first, key=first.get) if h in second])
    want = 1.0 if a == b else common / max(len(first) + len(second) - common, 1)
    found = S.likeness(S.sketch(a), S.sketch(b))
    assert S.sketch(a).level == S.sketch(b).level == 0 and found == pytest.approx(want)
    assert S.likeness(S.sketch(b), S.sketch(a)) == found


def test_order_and_single_words_count():
    words = prose(5, 4000).split()
    text = " ".join(words)
    own = S.sketch(text)
    assert own.level > 0 and S.WHOLE < len(own.hash) < own.count
    assert S.likeness(own, S.sketch(" ".join(words[2000:] + words[:2000]))) < 0.5
    for k in range(0, 4000, 400):
        changed = S.sketch(" ".join([*words[:k], "otherwise", *words[k + 1 :]]))
        assert S.write(changed) != S.write(own) and 0.98 < S.likeness(own, changed) < 1
    tail = S.sketch(" ".join([*words[:3000], *prose(6, 1000).split()]))
    assert abs(S.likeness(own, tail) - 0.6) < 0.08


def test_long_and_short_texts():
    assert len(LONG) > 2 * S.PIECE
    at, hashes = S.anchors(LONG)
    whole = S._anchors(LONG)
    assert at.tolist() == whole[0].tolist() and hashes.tolist() == whole[1].tolist()
    back = S.parse(S.write(S.sketch(LONG)))
    assert S.likeness(back, S.sketch(LONG)) == 1 and back.level == S.sketch(LONG).level and len(back.hash) > 1000
    assert S.likeness(S.sketch(""), S.sketch(None)) == 1 and S.likeness(S.sketch(""), S.sketch("x")) == 0
    many, more = S.sketch("a" * 100_000), S.sketch("a" * 100_001)
    assert len(many.hash) == 1 and 0.99 < S.likeness(many, more) < 1


def test_splitters_of_two_levels(spark):
    rows = spark.range(10_000).selectExpr("id * 3 AS order")
    found = sorted(set(S._splitters(rows, 100, level=10)))
    assert len(found) == 99 and max(abs(x - 300 * (k + 1)) for k, x in enumerate(found)) <= 30
    assert S._splitters(rows, 1) == [] and len(S._splitters(rows, 10, level=10)) == 9


def brute(rows):
    """Every row with the row after it in falling order of id; ties may stand in any order."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), S.write(S.sketch(text)), S.write(S.sketch(edited))))
    return sorted(out, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("range_bytes", [1 << 25, 150, 600])
def test_edits_over_many_ranges(spark, range_bytes):
    rows = [(r[0], r[1]) for r in odd_rows(False) if r[0] is not None and r[0] != 2] + [(None, None)]
    rows += [(k, prose(k, k % 40)) for k in range(50, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = S.compare_with_edits(df, range_bytes=range_bytes)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=lambda r: (r[0] is None, r)) == brute(rows)


def test_odd_rows_and_whole_table(spark, folder):
    found = S.compare_with_edits(odd_documents(spark)).collect()
    assert len(found) == len(odd_rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert S.compare_with_edits(empty_documents(spark)).collect() == []
    one = spark.createDataFrame([(7, "only one")], "doc_id long, text string")
    (row,) = S.compare_with_edits(one).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"only oon").hexdigest()
    rows = queries.QUERIES["op1_syncmers"](spark, folder).collect()
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows) + 0.2 * len(rows)
    assert {r.fingerprint for r in S.fingerprints(odd_documents(spark)).where("doc_id in (1, 2)").collect()} == {S.write(S.sketch(prose(1, 60)))}
