import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from compare import connect
from lagwise.llm import phrases as P
from lagwise.llm import queries
from llm_data import assert_same_as_sql, empty_documents, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    found = {}
    for lang, text in rows:
        own = found.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for length in range(1, 5):
                own.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    return found


def brute(rows, threshold, top, percent):
    out = []
    for lang, f in brute_counts(rows).items():
        many = {p: n for p, n in f.items() if len(p) > 1 and n >= threshold}
        kept = []
        for p, a in many.items():
            inside = any(
                len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in many.items()
            )
            if not inside:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i, t.decode(), -a, left, right, n, -s) for i, (s, a, t, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made_up(seed, texts):
    rng = random.Random(seed)
    names = ["New York", "new York city hall", "ça VA", "a a a a", "to be or not", "É é", "x\x00y z"]
    rows = []
    for _ in range(texts):
        words = []
        for _ in range(rng.randrange(2, 40)):
            words.append(rng.choice(names) if rng.random() < 0.4 else rng.choice("of the and in on at".split()))
            words.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", " ? "]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(words)))
    # a phrase whose words meet late: its parts reach the threshold in one shard of the circle only
    return rows + [("fr", "rare pair here now")] * 6 + [("fr", None), (None, ""), ("it", " .,"), (None, "ends. with")]


def test_matches_sql(spark, folder):
    assert_same_as_sql(queries.QUERIES["op11_phrases"](spark, folder), connect(folder), queries.ORACLE["op11_phrases"])


@pytest.mark.parametrize("shards,top,percent", [(1, 1000, 80), (3, 4, 100), (5, 1000, 50)])
def test_brute_force(spark, shards, top, percent):
    rows = made_up(shards, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = P.collocations(docs, threshold=6, top=top, percent=percent, shards=shards)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 6, top, percent)


def test_full_slot_table_changes_no_count(spark):
    rows = made_up(9, 100)
    expected = {(lang, p): n for lang, f in brute_counts(rows).items() for p, n in f.items()}
    # every slot taken: all phrases are active, whatever was reached
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    found = [r for out in P.count_step([batch], 2, 3, np.full(16, 1, dtype=np.uint8)) for r in out.to_pylist()]
    assert sorted(r["n"] for r in found) == sorted(expected.values())
    assert {(r["length"], r["since"]) for r in found} == {(1, 0), (2, 1), (3, 1), (4, 1)}
    counts = Counter()
    for out in P.count_taken([batch], np.full(16, 1, dtype=np.uint8)):
        for r in out.to_pylist():
            counts[r["lang"], tuple(r["phrase"].split(" "))] += r["n"] if r["length"] else 0
    assert +counts == expected
    docs = spark.createDataFrame(rows, "lang string, text string")
    few = P.phrase_counts(docs, 5, shards=3, slots=P.CHUNK).where("length > 0")
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in few.collect()} == {k: n for k, n in expected.items() if n >= 5}


def test_a_step_counts_what_is_in_its_cycle(spark):
    batch = pa.record_batch([pa.array(["en"]), pa.array(["a b c d"])], names=["lang", "text"])
    reached = np.full(P.SLOTS, P.LATER, dtype=np.uint8)
    seed = np.array([P.lang_seed("en")])
    for word, step in (("a", 1), ("b", 3), ("c", 2)):
        h = P.combined([P._byte_hashes(pa.array([word.encode()], pa.large_binary()))], seed)
        reached[P._slot(h, P.SLOTS)] = step
    lengths = lambda step: [(r["length"], r["since"]) for out in P.count_step([batch], step, 4, reached) for r in out.to_pylist()]
    assert lengths(0) == [(1, 0)] * 4
    assert lengths(2) == [(1, 0)] * 4
    assert lengths(3) == [(1, 0)] * 4 + [(2, 3)] * 2
    assert lengths(6) == [(2, 3)] * 2
    assert lengths(7) == []


def test_counts_of_long_texts_in_parts(spark):
    text = "\n".join(f"the long walk {i % 50} home" for i in range(150_000))
    docs = spark.createDataFrame([("en", text), ("en", "the long")], "lang string, text string")
    counts = {r.phrase: r.n for r in P.phrase_counts(docs, 1000, shards=2).collect()}
    assert counts["the long"] == 150_001 and counts["the long walk"] == 150_000 and counts["walk 7 home"] == 3_000


def test_score_is_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_001
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 1)]
    found = P.scored(spark.createDataFrame(rows, "lang string, length int, phrase string, n long"), 30).collect()
    assert [(r.a, r.l, r.r, r.score) for r in found] == [(big - 1, big, big + 2, 2000000 * (big - 1) // (2 * big + 2))]


def test_odd_rows_and_empty_table(spark):
    assert P.collocations(empty_documents(spark)).collect() == []
    found = P.collocations(odd_documents(spark, False), threshold=3, shards=2).collect()
    assert found and {r.lang for r in found} <= {"en", "und"}


def test_last_scan_leaves_out_phrases_with_an_infrequent_part(spark):
    """A phrase whose slot is taken by chance is not shuffled when one of its parts is not frequent."""
    batch = pa.record_batch([pa.array(["en"]), pa.array(["a b c"])], names=["lang", "text"])
    reached = np.full(P.SLOTS, P.LATER, dtype=np.uint8)
    seed = np.array([P.lang_seed("en")])
    words = [P._byte_hashes(pa.array([w], pa.large_binary())) for w in (b"a", b"b", b"c")]
    for phrase in ([0], [1], [0, 1], [1, 2], [0, 1, 2]):  # not c, so "b c" and "a b c" only share a slot
        reached[P._slot(P.combined([words[k] for k in phrase], seed), P.SLOTS)] = 1
    found = [r["phrase"] for out in P.count_taken([batch], reached) for r in out.to_pylist() if r["length"]]
    assert sorted(found) == ["a", "a b", "b"]


def test_steps_store_two_numbers_and_no_closed_phrase(spark, monkeypatch):
    stored, plain = [], P.replace_stored

    def kept(df, label, old=None):
        table, path = plain(df, label, old)
        if label == "phrases-open":
            stored.append((table.columns, table.collect()))
        return table, path

    monkeypatch.setattr(P, "replace_stored", kept)
    rows = made_up(4, 80)
    found = P.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 6, shards=2).where("length > 0").collect()
    expected = {(lang, p): n for lang, f in brute_counts(rows).items() for p, n in f.items() if n >= 6}
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found} == expected
    assert all(columns == ["h", "n"] for columns, _ in stored)
    for step, (_, numbers) in enumerate(stored):
        assert all(r.n >= 6 or (r.h >> P.SINCE_BIT) + 2 > step + 1 for r in numbers)


def test_a_step_leaves_out_phrases_whose_slots_are_taken():
    batch = pa.record_batch([pa.array(["en"]), pa.array(["a b a"])], names=["lang", "text"])
    reached = np.full(P.SLOTS, P.LATER, dtype=np.uint8)
    word = P._byte_hashes(pa.array([b"a"], pa.large_binary()))
    reached[P._slot(P.combined([word], np.array([P.lang_seed("en")])), P.SLOTS)] = 1
    found = [r for out in P.count_step([batch], 1, 4, reached, False) for r in out.to_pylist()]
    assert [(r["length"], r["n"]) for r in found] == [(1, 1)]  # b


def test_word_hashes_of_any_length_do_not_depend_on_place():
    rng = np.random.default_rng(3)
    words = [rng.integers(97, 123, size, dtype=np.uint8) for size in [*range(0, 140), 5000]]
    words += [np.append(w[:-1], w[-1] ^ 1) for w in words if len(w)]
    ends = np.cumsum([len(w) for w in words])
    begins = ends - [len(w) for w in words]
    found = P._word_hashes(np.concatenate(words), begins, ends)
    alone = [P._word_hashes(w, np.array([0]), np.array([len(w)]))[0] for w in words]
    assert found.tolist() == [int(h) for h in alone]
    assert len(set(found.tolist())) == len({w.tobytes() for w in words})


def test_a_slot_taken_by_the_longest_phrases_stays_open_to_shorter_ones(spark):
    """Else the cycle could end before phrases that follow from the shorter one were counted in every shard."""
    reached = np.full(P.CHUNK, P.LATER, dtype=np.uint8)
    slot, numbers = np.array([5], dtype=np.uint64), {}
    for length in (2, 4):
        numbers[length] = int(P._number(slot, length, np.array([1], dtype=np.uint8))[0])
    frequent = lambda length: spark.createDataFrame([(numbers[length], 9)], "h long, n long")
    assert not P._mark(reached, frequent(4), 3) and reached[5] == P.LONGEST
    assert P._mark(reached, frequent(2), 4) and reached[5] == 4
    assert not P._mark(reached, frequent(4), 5) and reached[5] == 4
    batch = pa.record_batch([pa.array(["en"]), pa.array(["a b"])], names=["lang", "text"])
    only = np.full(P.CHUNK, P.LONGEST, dtype=np.uint8)
    assert [[r["length"], r["n"]] for out in P.count_step([batch], 0, 4, only, False) for r in out.to_pylist()] == [[1, 1], [1, 1]]
    assert not list(P.count_step([batch], 4, 4, only, False))
