import random
import zlib

import pytest

from compare import connect
from lagwise.llm import queries
from lagwise.llm import spelling as S
from llm_data import assert_same_as_sql, empty_documents, odd_documents


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, ratio=5):
    found = {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if near(w, o)]
        best = min(others) if others else None
        form = best[1] if best and -best[0] >= ratio * n else None
        found[w] = (len(others), form, form and words[form])
    out = []
    for w, n in words.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        out.append((w, n, *found[w], root))
    return sorted(out)


def edited(rng, word):
    at, letter, kind = rng.randrange(len(word) + 1), rng.choice("abcéñ"), rng.randrange(3)
    return word[:at] + (letter if kind else "") + word[at + (kind != 1) :]


def made_up(seed, size):
    rng, words = random.Random(seed), set()
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randrange(6, 9))) for _ in range(size // 8)]
    stems += ["x" * 62 + s for s in stems[:4]] + ["ab" * 40 + s + "ba" * 40 for s in stems[:4]]
    for s in stems:
        chain = s
        for _ in range(6):
            words.add(chain)
            chain = edited(rng, chain) if rng.random() < 0.5 else edited(rng, s)
    return {w: rng.choice([5, 6, 30, 31, 200, 1000, 1000, 6000]) for w in sorted(words) if len(w) >= 6}


def test_matches_sql(spark, folder):
    assert_same_as_sql(
        queries.QUERIES["op13_spelling_variants"](spark, folder), connect(folder), queries.ORACLE["op13_spelling_variants"]
    )


@pytest.mark.parametrize("frequent", [1, 8, 100])
def test_brute_force(spark, frequent):
    words = made_up(frequent, 300)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = S.variants(table, frequent=frequent).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in found.collect()) == brute(words)
    assert any(len(w) > 2 * S.REACH and c for w, _, c, *_ in brute(words))


def test_grams_stop_growing_when_they_are_rare(spark):
    words = spark.createDataFrame([("abcdefg", 5, 1, 1), ("abcdxyz", 5, 2, 2), ("abcduvw", 5, 3, 3)], "word string, n long, w1 long, w2 long")
    grams = {r.w1: [g.gram for g in r.grams] for r in S.decompose(words, frequent=1).collect()}
    assert sorted(grams[1]) == sorted(["^abcde", "abcde", "bcde", "cde", "de", "ef", "fg", "g$"])
    loose = {r.w1: {g.gram for g in r.grams} for r in S.decompose(words, frequent=3).collect()}
    assert all(len(g) == 2 for grams in loose.values() for g in grams)


def test_words_and_slips(spark):
    texts = [(i, "Überzug überzug_ÜBERZUG tiny naïveté") for i in range(400)]
    docs = spark.createDataFrame([*texts, (None, None), (None, "naïveté " * 3)], "doc_id long, text string")
    expected = {}
    for i, text in [*texts, ("", "naïveté " * 3)]:
        for run in text.replace("_", " ").translate(str.maketrans(S.UPPER, S.UPPER.lower())).split():
            h = zlib.crc32(f"{i}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 199 == 0 else run
            expected[word] = expected.get(word, 0) + 1
    assert dict(S.word_counts(docs).collect()) == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    assert dict(S.word_counts(docs, one_in=None).collect()) == {"Überzug": 800, "überzug": 400, "naïveté": 403}


def test_odd_rows_and_empty_table(spark):
    counts = S.word_counts(odd_documents(spark), min_count=1)
    assert counts.where("word is null or char_length(word) < 6").count() == 0
    assert S.variants(S.word_counts(odd_documents(spark), min_count=2)).count() > 0
    assert S.variants(S.word_counts(empty_documents(spark))).collect() == []
