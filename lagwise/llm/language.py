"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, fixed by its code point. An n-gram of three
letters binds its letters' vectors, each permuted (rolled) by its place, by multiplication. The sum
of the vectors of all n-grams of a text is its profile, and the sum over all texts of a language is
the prototype of that language. A text is given the language whose prototype has the largest cosine
with its profile; the score is that cosine taken to 0..1.

Letters are lower-cased; what stands between words counts as one edge, which may be the first or the
last sign of an n-gram, so that beginnings and ends of words count.

Prototypes cover all texts that may be learnt from: n-grams are counted per language first (summed
before the shuffle), then each is bound once.

Edge cases: a null text and a text without letters are ``und`` with score 0; so is every text if
nothing can be learnt from. Ties go to the first language in order of name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm import words as W

DIMENSIONS = 512
#: Dense counts held at a time.
CELLS = 1 << 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for code in range(0x110000):
        sign = chr(code)
        if sign.isalpha():
            table[code] = ord(sign.lower()[0])
    return table


class Grams(NamedTuple):
    """n-grams of the texts of a piece: text and number of each, and the letters of each number."""

    first: int
    texts: int
    letters: np.ndarray  # letters in each text
    text: np.ndarray
    number: np.ndarray
    grams: np.ndarray  # numbers x 3 code points, 0 for an edge


def grams(column: pa.Array) -> Iterator[Grams]:
    data, ends = W.text_bytes(column)
    for at, stop in W.pieces(ends):
        part = data[int(ends[at]) : int(ends[stop])]
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        heads = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=heads[1:])
        edges = heads[ends[at : stop + 1] - ends[at]]
        signs = _letters()[codes]
        text = np.repeat(np.arange(stop - at), np.diff(edges))
        letters = np.bincount(text[signs > 0], minlength=stop - at)
        keep = signs > 0
        keep[1:] |= (signs[:-1] > 0) & (text[1:] == text[:-1])  # one edge after each run of letters
        signs, text = signs[keep], text[keep]
        first = np.flatnonzero(np.diff(text, prepend=-1))  # each text also begins and ends with an edge
        last = np.append(first[1:], len(text))[: len(first)]
        both, owner = np.concatenate([last, first]), np.concatenate([text[last - 1], text[first]])
        signs, text = np.insert(signs, both, 0), np.insert(text, both, owner)
        used, compact = np.unique(signs, return_inverse=True)
        size = len(used)
        a, b, c = compact[:-2], compact[1:-1], compact[2:]
        good = (text[2:] == text[:-2]) & (signs[1:-1] > 0) if len(signs) > 2 else np.zeros(0, dtype=bool)
        keys = ((a * size + b) * size + c)[good]
        if size**3 <= 1 << 21:
            present = np.flatnonzero(np.bincount(keys, minlength=1))
            place = np.zeros(size**3 + 1, dtype=np.int64)
            place[present] = np.arange(len(present))
            number = place[keys]
        else:
            present, number = np.unique(keys, return_inverse=True)
        spelled = np.stack([used[present // (size * size)], used[present // size % size], used[present % size]], axis=1) if size else np.zeros((0, 3), dtype=np.int32)
        yield Grams(at, stop - at, letters, text[:-2][good] if len(text) > 2 else text[:0], number, spelled)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of signs per code point."""
    words = DIMENSIONS // 64
    seeds = W.mix(codes.astype(np.uint64)[:, None] * np.uint64(words + 1) + np.arange(1, words + 1, dtype=np.uint64) + W.numbers(1, 31)[0])
    bits = np.unpackbits(seeds.view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(spelled: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams: the product of the letters' vectors, each rolled by its place."""
    used, compact = np.unique(spelled, return_inverse=True)
    vectors = letter_vectors(used)
    compact = compact.reshape(spelled.shape)
    bound = vectors[compact[:, 2]]
    bound *= np.roll(vectors, 1, axis=1)[compact[:, 1]]
    bound *= np.roll(vectors, 2, axis=1)[compact[:, 0]]
    return bound


class Prototypes(NamedTuple):
    languages: list[str]
    vectors: np.ndarray  # unit length


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each language in a batch, counted."""
    for batch in batches:
        names = batch.column(1).dictionary_encode()
        language = names.indices.to_numpy(zero_copy_only=False)
        for found in grams(batch.column(0)):
            size = max(len(found.grams), 1)
            pairs, counts = np.unique(language[found.first + found.text] * size + found.number, return_counts=True)
            spelled = found.grams[pairs % size] if len(pairs) else np.zeros((0, 3), dtype=np.int32)
            columns = [names.dictionary.take(pa.array(pairs // size)), *[pa.array(spelled[:, k].astype(np.int32)) for k in range(3)], pa.array(counts)]
            yield pa.record_batch(columns, names=["lang", "a", "b", "c", "n"])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the n-gram vectors of each language in a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        spelled = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
        counts = batch.column(4).to_numpy().astype(np.float64)
        for at in range(0, len(counts), 4096):
            bound = gram_vectors(spelled[at : at + 4096])
            for name in set(languages[at : at + 4096]):
                mine = np.where(languages[at : at + 4096] == name, counts[at : at + 4096], 0)
                sums[name] = sums.get(name, np.zeros(DIMENSIONS)) + mine @ bound
    names = sorted(sums)
    vectors = pa.array([sums[n].tolist() for n in names], type=pa.list_(pa.float64()))
    yield pa.record_batch([pa.array(names, type=pa.string()), vectors], names=["lang", "vector"])


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> Prototypes:
    """Prototypes of all languages named in ``documents``; rows without text or language are left out.

    The driver receives one vector per language and partition.
    """
    counts = (
        documents.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        .where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(_language_counts, "lang string, a int, b int, c int, n long")
        .groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))
    )
    sums: dict[str, np.ndarray] = {}
    for r in sorted(counts.mapInArrow(_bundles, "lang string, vector array<double>").collect(), key=lambda r: (r.lang, r.vector)):
        sums[r.lang] = sums.get(r.lang, np.zeros(DIMENSIONS)) + np.array(r.vector)
    languages = sorted(sums)
    vectors = np.array([sums[n] / max(np.linalg.norm(sums[n]), 1e-12) for n in languages]).reshape(-1, DIMENSIONS)
    return Prototypes(languages, vectors.astype(np.float32))


def _profiles(found: Grams) -> np.ndarray:
    """Profile of every text of a piece."""
    out = np.zeros((found.texts, DIMENSIONS), dtype=np.float32)
    width = 8192
    order = np.argsort(found.text, kind="stable") if np.any(np.diff(found.text) < 0) else None
    text, number = (found.text, found.number) if order is None else (found.text[order], found.number[order])
    for low in range(0, len(found.grams), width):
        bound = gram_vectors(found.grams[low : low + width])
        rows = max(1, CELLS // len(bound))
        for first in range(0, found.texts, rows):
            begin, stop = np.searchsorted(text, [first, first + rows])
            own = number[begin:stop] - low
            inside = (own >= 0) & (own < len(bound))
            count = min(rows, found.texts - first)
            held = np.bincount((text[begin:stop][inside] - first) * len(bound) + own[inside], minlength=count * len(bound))
            out[first : first + count] += held.reshape(count, -1).astype(np.float32) @ bound
    return out


def identify(column: pa.Array, prototypes: Prototypes) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of an Arrow column."""
    names: list[str] = []
    scores: list[np.ndarray] = []
    for found in grams(column):
        profile = _profiles(found)
        norm = np.linalg.norm(profile, axis=1)
        if not prototypes.languages:
            names += [UNKNOWN] * found.texts
            scores.append(np.zeros(found.texts))
            continue
        cosine = profile @ prototypes.vectors.T / np.maximum(norm, 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        known = found.letters > 0
        names += [prototypes.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        scores.append(np.where(known, np.clip((cosine[np.arange(found.texts), best] + 1) / 2, 0, 1), 0.0).astype(np.float64))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def predicted(documents: DataFrame, prototypes: Prototypes, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with language and score; columns of these names are replaced."""
    documents = documents.drop(lang, score)
    shared = documents.sparkSession.sparkContext.broadcast(prototypes)  # one vector per language

    def run(batches):
        for batch in batches:
            names, scores = identify(batch.column(batch.schema.names.index(text)), shared.value)
            yield pa.record_batch([*batch.columns, pa.array(names, type=pa.string()), pa.array(scores)], names=[*batch.schema.names, lang, score])

    added = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *added]))


def learn_where(documents: DataFrame, may_learn: Column, **names) -> Prototypes:
    return learn(documents.where(may_learn), **names)
