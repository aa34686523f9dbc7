import re

import numpy as np
import pyarrow as pa
import pytest

from lagwise.llm import words as W
from llm_data import LONG, odd_rows

TEXTS = [r[1] for r in odd_rows()] + ["A-b_C d\x00e é É", " lead", "trail "]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize(
    "kind, pattern",
    [(W.BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (W.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.SIGNS_TOO, r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\x20\x09-\x0D]+")],
)
def test_words_are_those_of_the_pattern(kind, pattern):
    found, seen = {}, 0
    for piece in W.words(pa.array(TEXTS), kind):
        for k in range(piece.texts):
            own = piece.hash[piece.text == k]
            expected = re.findall(pattern, (TEXTS[piece.first + k] or "").translate(LOWER))
            assert len(own) == len(expected)
            for h, w in zip(own.tolist(), expected):
                assert found.setdefault(w, h) == h
            seen += 1
    assert seen == len(TEXTS)
    assert len(set(found.values())) == len(found)


def test_shingle_sets_match_sets_of_tuples():
    for piece in W.words(pa.array(TEXTS), W.BLANK_SEPARATED):
        text, values = W.shingle_sets(piece, 5)
        for k in range(piece.texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", (TEXTS[piece.first + k] or "").translate(LOWER))
            expected = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
            own = values[text == k]
            assert len(own) == len(expected) and (np.diff(own) > 0).all()


def test_a_text_longer_than_a_piece_is_read_whole():
    assert len(LONG) > W.PIECE
    (piece,) = W.words(pa.array([LONG]), W.BLANK_SEPARATED)
    (short,) = W.words(pa.array([LONG[-200:].split(" ", 1)[1]]), W.BLANK_SEPARATED)
    assert (piece.hash[-len(short.hash) :] == short.hash).all()
    assert len(next(W.words(pa.array(["x" * (W.PIECE + 5)]), W.BLANK_SEPARATED)).hash) == 1
