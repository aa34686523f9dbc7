import numpy as np
import pyarrow as pa

from lagwise.llm import language, quality, queries
from llm_data import empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_quality"](spark, FOLDER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert rows == queries.QUERIES["op6_quality"](spark, FOLDER).collect()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (11, 0), (None, 1), (13, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = quality.fit(odd_documents(spark), given, F.lit(True))
        found = quality.scored(odd_documents(spark), model)
        assert sorted(found.columns) == sorted(odd_documents(spark).columns)
        assert len(found.collect()) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found.collect())
    assert quality.scored(empty_documents(spark), quality.fit(empty_documents(spark), labels, F.lit(True))).collect() == []


def test_pooling_is_the_mean_of_word_vectors():
    texts = pa.array(["a b c", None, "B b, x", "x " * 5000])
    one = next(quality.W.words(texts, quality.W.SIGNS_TOO))
    vectors = quality.Vectors(np.unique(one.hash)[:3], np.eye(3, quality.DIMENSIONS, dtype=np.float32))
    found = quality._pool(one, vectors)
    for k in range(4):
        want = np.zeros(2 * quality.DIMENSIONS)
        own = np.flatnonzero(one.text == k)
        for i in own:
            for at, sign in quality._signs(one.hash[i : i + 1]):
                want[at[0]] += sign[0]
            n = vectors.number(one.hash[i : i + 1])[0]
            if n >= 0:
                want[quality.DIMENSIONS :] += vectors.context[n]
            for event, seen in zip(quality._EVENTS, (one.upper[i] > 1, quality._repeats(one)[i])):
                for at, sign in quality._signs(np.array([event])):
                    want[at[0]] += 2 * sign[0] * seen
        assert np.allclose(found[k], want / max(len(own), 1), atol=1e-4)


def test_held_out_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language"](spark, FOLDER).collect()
    assert len(rows) == 1000
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_language_of_odd_rows(spark):
    learnt = language.learn(odd_documents(spark))
    assert learnt.languages == ["de", "en", "es", "fr"]
    rows = language.predicted(odd_documents(spark), learnt).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert isinstance(r.score, float) and 0 <= r.score <= 1
    none = language.learn(empty_documents(spark))
    assert {r.lang_pred for r in language.predicted(odd_documents(spark), none).collect()} == {"und"}
    assert language.predicted(empty_documents(spark), learnt).collect() == []


def test_profile_is_the_sum_of_bound_letters():
    texts = ["Ab, cé", "", "x", "12 !", "日本語", "straße " * 3]
    found = next(language.grams(pa.array(texts)))
    profiles = language._profiles(found)
    for k, text in enumerate(texts):
        signs = [0]
        for c in text:
            code = ord(c.lower()[0]) if c.isalpha() else 0
            if code or signs[-1]:
                signs.append(code)
        if signs[-1]:
            signs.append(0)
        want = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(signs, signs[1:], signs[2:]):
            if b:
                v = language.letter_vectors(np.array([a, b, c], dtype=np.int32))
                want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert np.array_equal(profiles[k], want)
