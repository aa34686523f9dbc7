"""Document fingerprints from closed syncmers.

A k-mer (``K`` code points) is chosen if the least of its inner s-mers (``S`` code points, compared
by hash) stands at its first or its last place. The choice looks at nothing but the k-mer itself, so
an edit moves no anchor outside the k-mers it touches: anchors of two texts can be matched with their
positions.

A fingerprint holds a hash of all anchors with their positions, their number, and anchors in the order of the
text, each with its position and hash, the first of those that repeat. Of a text of up to ``WHOLE`` anchors
these are all. Of longer ones every 2nd, 4th, ... is left out by its hash, so that their number grows with the
root of the text's length; two fingerprints are compared at the coarser of their levels, where both hold
the same choice of hashes. The likeness is the longest chain of shared anchors that stand in one order in both
texts, over all anchors of the two: 1 for equal sequences of anchors alone, and lower for passages that
are there but have changed places. For texts of up to ``WHOLE`` anchors it is exact, else an estimate.

Edge cases: a null or empty text has no anchors and the fingerprint of none; two of these are alike (1), an
empty and a filled one are not (0). A text shorter than a k-mer is its own one anchor. Very long texts are
read ``PIECE`` code points at a time, so of them only the text itself and its anchors (16 bytes each, about one in
four code points) are held. Equal rows have equal fingerprints; rows of one doc_id are ordered by a hash of
the text. An empty table gives an empty one. Columns named like the fingerprint are replaced, others keep their values.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm import words as W

K, S, WHOLE = 12, 5, 128
LEAST = -(1 << 63)
#: Texts worked on at a time.
ROWS = 256
#: Code points looked at together.
PIECE = 1 << 20
#: Ranges that one pass of percentiles cuts ids into, and its accuracy.
LEVEL, ACCURACY = 1000, 100_000
_CODE = W.numbers(1, 41)[0] | np.uint64(1)


class Fingerprint(NamedTuple):
    digest: int  # of all anchors with their positions
    count: int  # of all anchors
    at: np.ndarray  # positions of the anchors that are kept, ascending
    hash: np.ndarray  # their hashes, all distinct

    @property
    def level(self) -> int:
        """How often half of the anchors have been left out."""
        return max(0, (self.count - 1) // WHOLE).bit_length() + 1 >> 1


def _anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = len(codes)
    powers, inverses = W._power_tables(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((codes * _CODE + np.uint64(1)) * powers[:size], out=sums[1:])
    if size < K:
        return np.zeros(min(size, 1), dtype=np.int64), W.mix(sums[size:] + np.uint64(size))[: min(size, 1)]
    inner = W.mix((sums[S:] - sums[:-S]) * inverses[: size - S + 1])
    reach = K - S + 1
    least, have = inner, 1
    while have < reach:  # minima over twice the places each time
        step = min(have, reach - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[reach - 1 :]))
    return at, W.mix((sums[at + K] - sums[at]) * inverses[at] + np.uint64(1))


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points from 0) and 64-bit hashes of the closed syncmers of a text."""
    text = text or ""
    if len(text) <= PIECE + K:
        return _anchors(text)
    found = []
    for start in range(0, len(text) - K + 1, PIECE):  # each k-mer starts in one piece
        at, hashes = _anchors(text[start : start + PIECE + K - 1])
        found.append((at + start, hashes))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _thinned(hashes: np.ndarray, level: int) -> np.ndarray:
    """Places of the hashes that are kept at a level: the least of their range, one at least."""
    kept = np.flatnonzero(hashes < np.uint64(1 << 32 >> level)) if level else np.arange(len(hashes))
    return kept if len(kept) or not len(hashes) else np.flatnonzero(hashes == hashes.min())


def sketch(text: str | None) -> Fingerprint:
    at, hashes = anchors(text)
    digest = int(np.sum(W.mix(hashes + W._BASE * (at.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)) if len(at) else 0
    whole = Fingerprint(digest, len(at), at, hashes >> np.uint64(32))
    kept = _thinned(whole.hash, whole.level)
    first = np.sort(np.unique(whole.hash[kept], return_index=True)[1])
    return whole._replace(at=at[kept][first], hash=whole.hash[kept][first])


def write(values: Fingerprint) -> str:
    """Digest (16 digits), number of anchors (8), then position and hash of each anchor kept (8 each), in hex."""
    pairs = np.stack([values.at.astype(np.uint64), values.hash], axis=1)
    return f"{values.digest:016x}{values.count:08x}" + pairs.astype(">u4").tobytes().hex()


def parse(written: str) -> Fingerprint:
    pairs = np.frombuffer(bytes.fromhex(written[24:]), dtype=">u4").reshape(-1, 2)
    return Fingerprint(int(written[:16], 16), int(written[16:24], 16), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.uint64))


def chain(places: np.ndarray) -> int:
    """Length of the longest increasing chain of distinct places."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for place in places.tolist():
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends)


def likeness(one: Fingerprint, other: Fingerprint) -> float:
    """Anchors of the longest common chain over all anchors of both."""
    if one.digest == other.digest and one.count == other.count:
        return 1.0
    if not one.count or not other.count:
        return 0.0
    level = max(one.level, other.level)
    a, b = (f.hash[_thinned(f.hash, level)] for f in (one, other))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = chain(j[np.argsort(i)])
    # texts that differ are not wholly alike, even where the anchors kept are the same
    return min(common / (len(a) + len(b) - common), 1 - 1 / (one.count + other.count))


def match(one: str, other: str) -> np.ndarray:
    """Pairs of positions of anchors that two texts share and that occur once in each."""
    (p, a), (q, b) = anchors(one), anchors(other)
    a, first, count = np.unique(a, return_index=True, return_counts=True)
    b, second, number = np.unique(b, return_index=True, return_counts=True)
    shared, i, j = np.intersect1d(a[count == 1], b[number == 1], assume_unique=True, return_indices=True)
    pairs = np.stack([p[first[count == 1][i]], q[second[number == 1][j]]], axis=1)
    return pairs[np.argsort(pairs[:, 0])]


def fingerprints(documents: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint of each text; a column of that name is replaced."""
    documents = documents.drop(name)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.schema.names.index(text)).to_pylist()
                yield pa.record_batch([*part.columns, pa.array([write(sketch(t)) for t in texts])], names=[*part.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.StringType())]))


def _deal(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, largest: int) -> Iterator[pa.RecordBatch]:
    """Give each row its range of ids; the first rows of a range also go to the end of the one above it."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        bucket = np.searchsorted(splitters, ids, side="left")
        after = np.full(len(ids), -1)
        at = np.minimum(bucket, max(len(splitters) - 1, 0))
        if len(splitters):
            after[splitters[at] == ids] = (at + 1)[splitters[at] == ids]
        after[ids == largest] = 0  # the last document is followed by the first
        tail = np.flatnonzero(after >= 0)
        for rows, where, role in ((np.arange(len(ids)), bucket, 0), (tail, after[tail], 1)):
            if len(rows):
                part = batch if role == 0 else batch.take(pa.array(rows))
                added = [pa.array(where.astype(np.int32)), pa.array(np.full(len(rows), role, dtype=np.int32))]
                yield pa.record_batch([*part.columns, *added], names=[*batch.schema.names, "bucket", "role"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after another in falling order of id, each with the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    waiting, range_over = None, None
    rows: list[tuple] = []

    def finish(row, text, own, following, next_sketch):
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        edited = sketch(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((row, len(text), digest, write(own), write(edited), likeness(own, edited), likeness(own, next_sketch)))

    def out():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        made = pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)
        rows.clear()
        return made

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for own_id, doc_id, text, bucket, role in zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 4, 5))):
                if role == 1 and range_over == bucket:
                    continue
                values = sketch(text)
                if waiting is not None:
                    finish(waiting[0], waiting[1], waiting[2], text, values)
                waiting, range_over = ((doc_id, text, values), None) if role == 0 else (None, bucket)
            if len(rows) >= ROWS:
                yield out()
    yield out()


def _splitters(rows: DataFrame, ranges: int, level: int = LEVEL) -> list[int]:
    """Ids that cut the rows into about equal ``ranges``, by at most ``level`` in a pass, so accuracy needs not grow."""
    def shares(count: int) -> list[float]:
        return [k / count for k in range(1, count)]

    if ranges <= level:
        return rows.agg(F.percentile_approx("order", shares(ranges), ACCURACY)).first()[0] if ranges > 1 else []
    coarse = np.array(sorted(set(_splitters(rows, level, level))), dtype=np.int64)
    finer = -(-ranges // level)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.record_batch([pa.array(np.searchsorted(coarse, ids, side="left")), batch.column(0)], names=["part", "order"])

    parts = rows.select("order").mapInArrow(deal, "part long, order long")
    inner = parts.groupBy("part").agg(F.percentile_approx("order", shares(finer), ACCURACY).alias("ids")) if finer > 1 else None
    return coarse.tolist() + [k for row in (inner.collect() if inner else []) for k in row["ids"]]


def compare_with_edits(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprint every text, its edited text and the next one's in falling order of doc_id.

    The edited text is the text whose last third (rounded down) is replaced by the first as many code
    points of the next document; the last document is followed by the first. Equal doc_ids are
    ordered by a hash of the text, a null doc_id comes last.

    Each text is shuffled once, to its range of ids. Ranges end at ids that are there, so the first
    document of a range is known and a copy of it closes the range above.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.col(doc_id).cast("long")
    rows = documents.select(F.coalesce(own, F.lit(LEAST)).alias("order"), own.alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("tie"))
    total, largest = rows.agg(F.sum(F.octet_length("text")), F.max("order")).first()
    ranges = int((total or 0) // range_bytes) + 1
    splitters = sorted(set(_splitters(rows, ranges)) - {largest})
    grid = np.array(splitters, dtype=np.int64)
    dealt = rows.mapInArrow(lambda b: _deal(b, grid, largest), "order long, doc_id long, text string, tie long, bucket int, role int")
    return (
        dealt.repartitionById(len(splitters) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "role", F.desc("order"), "tie")
        .mapInArrow(
            _edit,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )
