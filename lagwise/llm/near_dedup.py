"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives every document its number of shingles, a 128-bit digest of its
   shingle set, ``bands * rows`` minima of which the low ``BITS`` bits are kept and packed into
   longs, and one key per band of ``rows`` full minima.
2. Documents of equal sets are one class, held from here on by its least doc_id.
3. Classes that share a band key are candidates. Each is first held against the least class of the
   bucket. Buckets whose classes are not all joined by these links are then compared inside tasks,
   in blocks: packed signatures first, full sets of the pairs whose signatures agree, and only links
   between classes not joined yet leave the task. No pair is emitted that is no link.
4. The similarity of a candidate pair is estimated from the number of agreeing groups of bits, less
   the agreement that chance gives. Pairs far below the threshold go; all others are confirmed on
   their full sets.
5. Confirmed links make components.

With 32 bands of 4 rows a pair of similarity 0.75 shares no band with probability 5e-6; the
estimate's margin is over six standard deviations (1e-9).

Edge cases: a null, empty or blank text has no shingles and is linked with nothing. A text of fewer
words than a shingle has its whole sequence as its one shingle. Rows that repeat a doc_id are one
document, linked by any of its texts. A null doc_id is linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm import words as W
from lagwise.llm.columns import apart
from lagwise.llm.components import components
from lagwise.session import materialize

BITS = 4
PER_LONG = 64 // BITS
_ONES = 0x1111111111111111
#: Share of pairs of unequal minima whose low bits agree.
CHANCE = 2.0**-BITS
#: Rows of a bucket compared with one another in one piece of work.
BLOCK = 1024
#: and shingles held for it, unless one document has more.
BLOCK_SHINGLES = 1 << 21


def _minima(values: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of each set; sets lie one after another and begin at ``begin``."""
    flips, factors = W.numbers(count, 11), W.numbers(count, 12) | np.uint64(1)
    found = np.empty((len(begin), count), dtype=np.uint64)
    for k in range(count):
        found[:, k] = np.minimum.reduceat((values ^ flips[k]) * factors[k], begin)
    return found


def pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of the (mixed) minima, ``PER_LONG`` of them to a long."""
    low = W.mix(minima) & np.uint64((1 << BITS) - 1)
    low = low.reshape(len(minima), -1, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=2)


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    salt = W.numbers(bands, 13)
    for batch in batches:
        for found in W.words(batch.column(1), W.BLANK_SEPARATED):
            text, values = W.shingle_sets(found, shingle)
            sizes = np.bincount(text, minlength=found.texts)
            full = np.flatnonzero(sizes)
            columns: list[pa.Array] = [batch.column(0).slice(found.first, found.texts), pa.array(sizes)]
            place = np.full(found.texts, -1, dtype=np.int64)
            place[full] = np.arange(len(full))
            place = pa.array(place, mask=place < 0)
            if len(full):
                begin = (np.cumsum(sizes) - sizes)[full]
                minima = _minima(values, begin, bands * rows)
                weights = W.numbers(rows, 14) | np.uint64(1)
                keys = W.mix((minima.reshape(len(full), bands, rows) * weights).sum(axis=2, dtype=np.uint64) + salt)
                digests = [np.add.reduceat(W.mix(values ^ s), begin) for s in W.numbers(2, 15)]
                packed = pack(minima)
            else:
                keys, packed = np.zeros((0, bands), np.uint64), np.zeros((0, bands * rows // PER_LONG), np.uint64)
                digests = [np.zeros(0, np.uint64)] * 2
            columns += [pa.array(d.view(np.int64)).take(place) for d in digests]
            for a in (packed, keys):
                ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * a.shape[1])
                columns.append(pa.ListArray.from_arrays(ends, pa.array(a.ravel().view(np.int64))).take(place))
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "d1", "d2", "signature", "keys"])


def sketch(documents: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), packed signature and band keys of every row."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda b: _sketches(b, shingle, bands, rows),
        "doc_id long, n_shingles long, d1 long, d2 long, signature array<long>, keys array<long>",
    )


def estimate(one: Column, other: Column, hashes: int) -> Column:
    """Similarity from the number of unequal groups of bits, corrected for chance agreement."""

    def unequal(total, x):
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return total + F.bit_count(x.bitwiseAND(F.lit(_ONES)))

    apart = F.aggregate(F.zip_with(one, other, lambda a, b: a.bitwiseXOR(b)), F.lit(0), unequal)
    return (1 - apart / F.lit(hashes) - F.lit(CHANCE)) / F.lit(1 - CHANCE)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The same for one signature against many, with numpy."""
    x = one ^ others
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    apart = np.bitwise_count(x & np.uint64(_ONES)).sum(axis=1)
    return (1 - apart / (others.shape[1] * PER_LONG) - CHANCE) / (1 - CHANCE)


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, salt, role, id, text) in order: a class, then its partners; gives the linked pairs."""
    holder, held = None, []
    for batch in batches:
        u, salt, role, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        left, right = [], []
        for found in W.words(batch.column(4), W.BLANK_SEPARATED):
            text, values = W.shingle_sets(found, shingle)
            ends = np.searchsorted(text, np.arange(found.texts + 1))
            for k in range(found.texts):
                row, own = found.first + k, values[ends[k] : ends[k + 1]]
                if role[row] == 0:
                    if holder != (u[row], salt[row]):
                        holder, held = (u[row], salt[row]), []
                    held.append(own.copy())
                    continue
                for other in held:
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    if 100 * len(small) < percent * len(large):
                        continue
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int(np.count_nonzero(large[place] == small))
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        left.append(u[row])
                        right.append(ids[row])
                        break
        yield pa.record_batch([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["u", "v"])


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, per_task: int = 64) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough.

    Partners of one class are dealt to as many groups as they need; each group reads the class once
    and its partners one by one, so that a task holds one set besides its batch.
    """
    groups = pairs.groupBy("u").agg(F.ceil(F.count("*") / per_task).alias("groups"))
    partners = pairs.join(groups, "u").select(
        "u", F.pmod(F.xxhash64("v"), F.col("groups")).alias("salt"), F.lit(1).alias("role"), F.col("v").alias("id")
    )
    holders = groups.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt")).select(
        "u", "salt", F.lit(0).alias("role"), F.col("u").alias("id")
    )
    wanted = partners.union(holders)
    return (
        wanted.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
        .select("u", "salt", "role", "id", "text")
        .repartition("u", "salt")
        .sortWithinPartitions("u", "salt", "role")
        .mapInArrow(lambda b: _confirm(b, shingle, percent), "u long, v long")
    )


class Member(NamedTuple):
    """A class in a bucket, with its component so far."""

    rep: int
    comp: int
    side: int
    keys: list[int]
    signature: list[int]
    shingles: np.ndarray


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of one sorted set with each of many (none is empty)."""
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    ends = np.cumsum([len(o) for o in others])
    return np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], ends[:-1]]))


def _block_links(key: int, rows: list[Member], least: float, percent: int) -> tuple[list[int], list[int]]:
    """Links that join different components in one block of a bucket, at most one fewer than rows.

    A pair is left to the first band that its two signatures share, and to the exact sets only if
    the signatures agree enough and no link found in the block joins the two already.
    """
    label, side = np.array([r.comp for r in rows]), np.array([r.side for r in rows])
    rep, size = np.array([r.rep for r in rows]), np.array([len(r.shingles) for r in rows])
    keys = np.array([r.keys for r in rows], dtype=np.int64)
    signature = np.array([r.signature for r in rows], dtype=np.int64).view(np.uint64)
    earlier = keys[:, : rows[0].keys.index(key)]
    two_sided = side.min() != side.max()
    left, right = [], []
    for k in range(len(rows) - 1):
        others = np.arange(k + 1, len(rows))
        others = others[label[others] != label[k]]
        if two_sided:
            others = others[side[others] != side[k]]
        others = others[100 * np.minimum(size[others], size[k]) >= percent * np.maximum(size[others], size[k])]
        others = others[estimates(signature[k], signature[others]) >= least]
        others = others[~(earlier[others] == earlier[k]).any(axis=1)]
        for at in range(0, len(others), 128):
            some = others[at : at + 128]
            some = some[label[some] != label[k]]
            if not len(some):
                continue
            common = _common(rows[k].shingles, [rows[o].shingles for o in some])
            for o in some[100 * common >= percent * (size[some] + size[k] - common)]:
                if label[o] != label[k]:
                    left.append(min(int(rep[o]), int(rep[k])))
                    right.append(max(int(rep[o]), int(rep[k])))
                    label[label == label[o]] = label[k]
    return left, right


def _cross_links(batches: Iterator[pa.RecordBatch], shingle: int, least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, rep, comp, side, keys, signature, text) ordered by block; gives links."""
    now: tuple = ()
    rows: list[Member] = []

    def out():
        left, right = _block_links(now[0], rows, least, percent) if len(rows) > 1 else ([], [])
        return pa.record_batch([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["u", "v"])

    for batch in batches:
        for found in W.words(batch.column(8), W.BLANK_SEPARATED):
            text, values = W.shingle_sets(found, shingle)
            ends = np.searchsorted(text, np.arange(found.texts + 1))
            part = batch.slice(found.first, found.texts)
            key, i, j, *rest = (part.column(k).to_pylist() for k in range(8))
            for k, (block, row) in enumerate(zip(zip(key, i, j), zip(*rest))):
                if block != now:
                    if len(rows) > 1:
                        yield out()
                    now, rows = block, []
                rows.append(Member(*row, values[ends[k] : ends[k + 1]].copy()))
    yield out()


def _same_bucket(
    buckets: DataFrame, reps: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, least: float, percent: int
) -> DataFrame:
    """Links between components inside buckets that still hold several."""
    named = (
        buckets.join(reps.select("rep", "n_shingles"), "rep")
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))
    )
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))
    mixed = (
        named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), blocks.alias("blocks"))
        .where("a < b").select("key", "blocks")
    )
    side = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    open_rows = (
        named.join(mixed, "key")
        .select("key", "rep", "comp", side.alias("side"), "blocks")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "rep", "comp", "side")
        .join(reps.select("rep", "keys", "signature"), "rep")
        .where(F.array_contains("keys", F.col("key")))  # a doc_id may have several texts
        .join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
        .select("key", "i", "j", "rep", "comp", "side", "keys", "signature", "text")
    )
    return (
        open_rows.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(lambda b: _cross_links(b, shingle, least, percent), "u long, v long")
    )


def near_duplicates(
    documents: DataFrame,
    shingle: int = 5,
    percent: int = 75,
    bands: int = 32,
    rows: int = 4,
    margin: float = 0.25,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents`` (doc_id, text)."""
    if bands * rows % PER_LONG:
        raise ValueError(f"bands * rows must be a multiple of {PER_LONG}")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = percent / 100 - margin
    sketches = materialize(sketch(documents, shingle, bands, rows), "sketches")
    filled = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    chosen = F.min_by(F.struct("n_shingles", "signature", "keys"), "doc_id")
    reps = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), chosen.alias("x"))
    reps = materialize(reps.select("rep", "x.n_shingles", "x.signature", "x.keys"), "classes")
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").select("key", "u")
    buckets = materialize(keyed.join(leaders, "key").select("key", "u", "rep"), "buckets")
    # a bucket may hold a doc_id twice where rows repeat it with other texts
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(documents.join(involved, "doc_id", "left_semi").distinct(), "texts")

    star = buckets.where("u <> rep").select("u", F.col("rep").alias("v")).distinct()
    one = reps.select(F.col("rep").alias("u"), F.col("signature").alias("one"))
    other = reps.select(F.col("rep").alias("v"), F.col("signature").alias("other"))
    near = star.join(one, "u").join(other, "v").where(estimate(F.col("one"), F.col("other"), bands * rows) >= least)
    links = materialize(confirm(materialize(near.select("u", "v").distinct(), "pairs"), texts, shingle, percent), "links")
    final = components(links)
    more = _same_bucket(buckets.select("key", "rep"), reps, final, texts, shingle, least, percent)
    final = components(links.union(materialize(more, "links")))
    grouped = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    found = sketches.select("doc_id", "n_shingles", "d1", "d2").join(grouped, ["d1", "d2"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_copies(documents: DataFrame, **settings) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id, all columns kept."""
    gone = near_duplicates(documents, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    own, restore = apart(documents, "_gone")
    return restore(own.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti"))
