"""Words and their 64-bit hashes for Arrow batches of texts, computed with numpy.

Texts are taken as UTF-8 bytes. A word is a run of word bytes; A-Z are lower-cased first. Bytes of
non-ASCII code points are all >= 0x80, so byte classes decide the same words as code point classes
whose members above 0x7F are all in or all out.

Memory is bounded by ``PIECE`` bytes of text at a time, whatever the size of a batch or of a text:
longer texts are cut between words and only their word hashes are kept together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection), so that every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def numbers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit numbers."""
    start = np.uint64((seed * 0x632BE59BD9B4E019 + 1) % (1 << 64))
    return mix(start + _BASE * np.arange(1, count + 1, dtype=np.uint64))


_CODES = numbers(256, 1) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES_LOWER = _CODES[_LOWER]
_CAPITAL = (_LOWER != np.arange(256)).astype(np.uint8)
_MULTIPLIERS = numbers(64, 2) | np.uint64(1)


def byte_class(outside: str) -> np.ndarray:
    """Word bytes: all but those in ``outside``, after A-Z have been lower-cased."""
    inside = np.ones(256, dtype=bool)
    inside[np.frombuffer(outside.encode("latin-1"), dtype=np.uint8)] = False
    return inside[_LOWER]


#: Words are whatever stands between blanks.
BLANK_SEPARATED = byte_class(" \t\n\x0b\x0c\r")
#: Words are runs of digits, letters and non-ASCII code points.
ALPHANUMERIC = byte_class("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

#: Runs of letters and digits are words, runs of other signs are words of their own.
SIGNS_TOO = np.where(ALPHANUMERIC, 1, np.where(BLANK_SEPARATED, 2, 0)).astype(np.uint8)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < size:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


class Words(NamedTuple):
    """Words of the texts ``first`` .. ``first + texts - 1`` of a batch, in order."""

    first: int
    texts: int
    text: np.ndarray  # number of the text, from 0, of each word
    hash: np.ndarray
    upper: np.ndarray  # capitals A-Z in each word

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), ends


def _scan(data: np.ndarray, starts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and number of capitals of every word of ``data``; none crosses a place in ``starts``.

    ``word`` gives each byte's class; a word is a run of one class other than 0.
    """
    size = len(data)
    kind = np.zeros(size + 2, dtype=np.uint8)
    kind[1:-1] = word[data]
    goes_on = kind[1:] == kind[:-1]  # from the byte before
    starts = starts[starts < size]
    goes_on[starts] = False
    begin = np.flatnonzero((kind[1:-1] > 0) & ~goes_on[:-1])
    end = np.flatnonzero((kind[1:-1] > 0) & ~goes_on[1:]) + 1
    powers, inverses = _power_tables(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_CODES_LOWER[data] * powers[:size], out=sums[1:])
    capitals = np.zeros(size + 1, dtype=np.int32)
    np.cumsum(_CAPITAL[data], out=capitals[1:])
    return begin, mix((sums[end] - sums[begin]) * inverses[begin]), capitals[end] - capitals[begin]


def _scan_long(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and capitals of the words of one text longer than a piece, read between words."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data):
            kind = word[data[stop - 1 : stop + PIECE]]
            gap = np.flatnonzero(kind[1:] != kind[:-1])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + PIECE, len(data))
        found.append(_scan(data[at:stop], np.zeros(1, dtype=np.int64), word)[1:])
        at = stop
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def pieces(ends: np.ndarray, limit: int = PIECE, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Cut texts into runs of at most ``limit`` bytes and ``most`` texts; a longer text is a run of its own."""
    at, texts = 0, len(ends) - 1
    while at < texts:
        stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), at + most, texts)
        yield at, stop
        at = stop


def words(column: pa.Array, word: np.ndarray) -> Iterator[Words]:
    """The words of all texts of a string column, a bounded piece at a time."""
    data, ends = text_bytes(column)
    for at, stop in pieces(ends):
        low, high = int(ends[at]), int(ends[stop])
        if high - low > PIECE:
            hashes, capitals = _scan_long(data[low:high], word)
            yield Words(at, 1, np.zeros(len(hashes), dtype=np.int64), hashes, capitals)
            continue
        starts = ends[at:stop] - low
        begin, hashes, capitals = _scan(data[low:high], starts, word)
        yield Words(at, stop - at, np.searchsorted(starts, begin, side="right") - 1, hashes, capitals)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and hash of every run of ``size`` words inside one text."""
    last = len(found.hash) - size + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = found.hash[:last] * _MULTIPLIERS[0]
    for k in range(1, size):
        total += found.hash[k : last + k] * _MULTIPLIERS[k]
    whole = np.flatnonzero(found.text[:last] == found.text[size - 1 :])
    return whole, mix(total[whole])


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one sequence of words."""
    weights = numbers(len(hashes), 3) | np.uint64(1)
    total = np.array([np.sum(hashes * weights, dtype=np.uint64)])
    return mix(total + np.uint64(len(hashes)))[0]


def shingle_sets(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text: (text, hash), ordered by text then hash.

    A text of fewer than ``size`` words, but not none, has its whole sequence as its one shingle.
    """
    at, values = shingles(found, size)
    texts = found.text[at]
    counts = found.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.searchsorted(found.text, short)
        extra = np.array([sequence_hash(found.hash[b : b + counts[t]]) for t, b in zip(short, begin)], dtype=np.uint64)
        texts, values = np.concatenate([texts, short]), np.concatenate([values, extra])
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    if len(texts):
        new = np.ones(len(texts), dtype=bool)
        new[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
        texts, values = texts[new], values[new]
    return texts, values
