"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together. Splitters are found
without moving a row: exact bytes and rows below a set of candidate boundaries are counted over all
partitions, each count narrows the bracket around every wanted splitter, and new candidates are set
inside the brackets until every splitter meets its tolerance. A bracket that holds one hash only (a
large group of equal texts) goes on over doc_id, so that a hot group is cut as well. Then each row
travels once, to the piece it belongs to; a shard has as many pieces as its size asks for, and a
row's slot is the exact number of rows before its piece plus its place in it.

Only counts reach the driver: a few numbers per candidate, whatever the number of rows. A round has at
most 65,536 candidates, or four per piece where there are more pieces than that allows, and each
splitter looks at the candidates of its own bracket, so the driver's work grows with the pieces.

Edge cases: a null text weighs nothing but its row's 1 and stands with the empty texts; a null
doc_id sorts first. Rows that repeat both text and doc_id cannot be told apart and stay together.
With fewer rows than shards some shards are empty, without rows all are. Texts are only hashed and
measured before the exchange, so a very long one costs its own bytes and stands in a piece of its own.
Columns named like the result's are replaced, those named like helper columns are set aside.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm.columns import apart
from lagwise.session import materialize

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_TEXT_KEY, _ROW_KEY, _PIECE = "_text_key", "_row_key", "_piece"
Key = tuple[int, int]
#: Candidate boundaries of a round for all splitters together.
GRID = 1 << 16


def _bucket(text_keys: np.ndarray, row_keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Number of probes at or below each key, in (text key, row key) order."""
    count = len(probes)
    texts = np.concatenate([probes[:, 0], text_keys])
    rows = np.concatenate([probes[:, 1], row_keys])
    order = np.lexsort((np.arange(len(texts)), rows, texts))
    below = np.cumsum(order < count)
    found = np.empty(len(texts), dtype=np.int64)
    found[order] = below
    return found[count:]


def _histogram(batches: Iterator[pa.RecordBatch], probes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bytes, rows and extreme keys between neighbouring probes, summed over a partition."""
    size = len(probes) + 1
    total, rows = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    low, high = np.full((size, 2), MOST), np.full((size, 2), LEAST)
    for batch in batches:
        text_keys, row_keys, sizes = (batch.column(k).to_numpy() for k in range(3))
        at = _bucket(text_keys, row_keys, probes)
        np.add.at(total, at, sizes)
        np.add.at(rows, at, 1)
        for k, values in enumerate((text_keys, row_keys)):
            np.minimum.at(low[:, k], at, values)
            np.maximum.at(high[:, k], at, values)
    at = np.flatnonzero(rows)
    columns = [at, total[at], rows[at], low[at, 0], high[at, 0], low[at, 1], high[at, 1]]
    yield pa.record_batch([pa.array(c) for c in columns], names=["bucket", "bytes", "n", "t0", "t1", "r0", "r1"])


class Bracket:
    """What is known about one wanted splitter: keys and exact counts on both sides of it."""

    def __init__(self, target: float, tolerance: float, total: int, count: int):
        self.target, self.tolerance = target, tolerance
        self.low: Key = (LEAST, LEAST)
        self.high: Key | None = None  # above every key
        self.below_low, self.below_high = (0, 0), (total, count)  # bytes, rows
        self.seen: tuple[int, int, int, int] | None = None  # extreme keys inside
        self.found = False
        self.splitter: Key | None = None  # once found: None stands above every key
        self.below: tuple[int, int] = (0, 0)

    def candidates(self, count: int) -> list[Key]:
        """Evenly spaced keys inside the bracket, over the row key once one text key is left."""
        if self.seen is None:
            step = (MOST - LEAST) // (count + 1)
            return [(LEAST + step * (k + 1), LEAST) for k in range(count)]
        t0, t1, r0, r1 = self.seen
        if t0 == t1:
            width = r1 - r0
            return [(t0, r0 + (width * (k + 1) + count - 1) // count) for k in range(count)] if width else []
        return [(t0 + ((t1 - t0) * (k + 1) + count - 1) // count, LEAST) for k in range(count)]

    def narrow(self, probes: list[Key], counts: "Counts") -> None:
        """Take in the exact counts below ordered probes; only the probes inside the bracket are looked at."""
        at = bisect.bisect_right(counts.bytes_below, self.target) - 1
        if at >= 0 and probes[at] > self.low:
            self.low, self.below_low = probes[at], counts.below(at)
        at = bisect.bisect_left(counts.bytes_below, self.target)
        if at < len(probes) and (self.high is None or probes[at] < self.high):
            self.high, self.below_high = probes[at], counts.below(at)
        nearest = min((self.low, self.below_low), (self.high, self.below_high), key=lambda x: abs(x[1][0] - self.target))
        first = bisect.bisect_left(probes, self.low) + 1
        last = len(probes) if self.high is None else bisect.bisect_right(probes, self.high) - 1
        held = counts.extremes(first, last)
        single = held is None or self.below_high[1] - self.below_low[1] <= 1
        if held is not None:
            self.seen = held
            single |= held[0] == held[1] and held[2] == held[3]
        if abs(nearest[1][0] - self.target) <= self.tolerance or single:
            self.found, (self.splitter, self.below) = True, nearest


class Counts:
    """One round of the histogram: bucket k stands before probe k, the last one after all probes."""

    def __init__(self, table: pa.Table, probes: int):
        at = table["bucket"].to_numpy()
        size, number = np.zeros(probes + 1, dtype=np.int64), np.zeros(probes + 1, dtype=np.int64)
        size[at], number[at] = table["bytes"].to_numpy(), table["n"].to_numpy()
        self.bytes_below, self.rows_below = (np.cumsum(x)[:-1].tolist() for x in (size, number))
        self.sides = []
        for name in ("t0", "t1", "r0", "r1"):
            side = np.full(probes + 1, MOST if name[1] == "0" else LEAST)
            side[at] = table[name].to_numpy()
            self.sides.append(side.tolist())

    def below(self, probe: int) -> tuple[int, int]:
        return self.bytes_below[probe], self.rows_below[probe]

    def extremes(self, first: int, last: int) -> tuple[int, int, int, int] | None:
        """Least and largest text key and row key in the buckets ``first`` to ``last``; None if they are empty."""
        if last < first:
            return None
        found = tuple(f(side[first : last + 1]) for f, side in zip((min, max, min, max), self.sides))
        return found if found[0] <= found[1] else None


def _next_probes(open_ones: list[Bracket], probes: int) -> list[Key]:
    """Bounds and candidates of all open brackets in order.

    Brackets that share their bounds share their candidates. The grid keeps to GRID keys, or to four a bracket
    where there are more brackets than that allows.
    """
    apart_ones = list({(b.low, b.high): b for b in open_ones}.values())
    each = max(2, min(probes, GRID // len(apart_ones)))
    known = {key for b in apart_ones for key in (b.low, b.high) if key is not None}
    return sorted(known | {key for b in apart_ones for key in b.candidates(each)})


def find_splitters(keys: DataFrame, shards: int, pieces: int, tolerance: float, probes: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of ``shards * pieces`` pieces and the exact number of rows before each piece.

    ``keys`` has a text key, a row key and a size. Boundaries of shards meet ``tolerance`` as a share
    of a shard's bytes, those of pieces inside a shard 0.2 of a piece, unless two neighbouring
    rows stand closer than that to neither side.
    """
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = [
        Bracket(total * k / (shards * pieces), total / shards * (tolerance if k % pieces == 0 else 0.2 / pieces), total, count)
        for k in range(1, shards * pieces)
    ]
    open_ones = wanted if count else []
    while open_ones:
        tried = _next_probes(open_ones, probes)
        grid = np.array(tried, dtype=np.int64).reshape(-1, 2)
        rows = (
            keys.mapInArrow(lambda b, grid=grid: _histogram(b, grid), "bucket long, bytes long, n long, t0 long, t1 long, r0 long, r1 long")
            .groupBy("bucket")
            .agg(*[F.sum(c).alias(c) for c in ("bytes", "n")], *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in ("t0", "t1", "r0", "r1")])
            .toArrow()
        )
        counts = Counts(rows, len(tried))
        for b in open_ones:
            b.narrow(tried, counts)
        open_ones = [b for b in open_ones if not b.found]
    ends = [((MOST, MOST) if b.splitter is None else b.splitter, b.below) for b in wanted]
    splitters = np.array([key for key, _ in ends], dtype=np.int64).reshape(-1, 2)
    return splitters, np.array([0] + [below[1] for _, below in ends], dtype=np.int64)


def _place(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text_keys, row_keys = (batch.column(names.index(c)).to_numpy() for c in (_TEXT_KEY, _ROW_KEY))
        piece = _bucket(text_keys, row_keys, splitters).astype(np.int32)
        yield pa.record_batch([*batch.columns, pa.array(piece)], names=[*names, _PIECE])


def _number(batches: Iterator[pa.RecordBatch], before: np.ndarray, pieces: int, shard: str, slot: str) -> Iterator[pa.RecordBatch]:
    """Shard and slot of the ordered rows of the pieces of a partition."""
    done: dict[int, int] = {}
    for batch in batches:
        names = batch.schema.names
        piece = batch.column(names.index(_PIECE)).to_numpy()
        slots = np.empty(len(piece), dtype=np.int64)
        for p in np.unique(piece).tolist():
            at = np.flatnonzero(piece == p)
            start = before[p] - before[p // pieces * pieces] + done.get(p, 0)
            slots[at] = start + np.arange(len(at))
            done[p] = done.get(p, 0) + len(at)
        shards = pa.array((piece // pieces).astype(np.int32))
        kept = [(n, c) for n, c in zip(names, batch.columns) if n not in (_TEXT_KEY, _ROW_KEY, _PIECE)]
        yield pa.record_batch([*[c for _, c in kept], shards, pa.array(slots)], names=[*[n for n, _ in kept], shard, slot])


def shard_by_bytes(
    documents: DataFrame,
    shards: int = 8,
    text: str = "text",
    doc_id: str = "doc_id",
    shard: str = "shard",
    slot: str = "slot",
    tolerance: float = 0.001,
    piece_bytes: int = 32 << 20,
) -> DataFrame:
    """``documents`` with ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard).

    The size of a row is the UTF-8 bytes of its text plus 1. Columns of these names are replaced.
    """
    documents, restore = apart(documents.drop(shard, slot), _TEXT_KEY, _ROW_KEY, _PIECE)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    text_key = F.xxhash64(content)
    row_key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST))
    keys = documents.select(text_key.alias("t"), row_key.alias("r"), (F.octet_length(content) + 1).cast("long").alias("size"))
    keys = materialize(keys, "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    pieces = int(total // (shards * piece_bytes)) + 1
    splitters, before = find_splitters(keys, shards, pieces, tolerance)
    keyed = documents.withColumn(_TEXT_KEY, text_key).withColumn(_ROW_KEY, row_key)
    placed = keyed.mapInArrow(lambda b: _place(b, splitters), T.StructType([*keyed.schema.fields, T.StructField(_PIECE, T.IntegerType())]))
    added = [T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())]
    return restore(
        placed.repartitionById(shards * pieces, F.col(_PIECE))
        .sortWithinPartitions(_PIECE, _TEXT_KEY, _ROW_KEY)
        .mapInArrow(lambda b: _number(b, before, pieces, shard, slot), T.StructType([*documents.schema.fields, *added]))
    )
