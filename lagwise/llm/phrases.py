"""Collocations: phrases mined by dynamic itemset counting, scored exactly.

A text is cut into pieces at ``. , ; : ! ?`` and line ends, a piece into words at blanks and tabs, with
A-Z lower-cased. Everything is counted per language.

Counting goes through the shards of the corpus in a circle, one shard a step, with all lengths
interleaved. A phrase of two words or more is activated as soon as both phrases one word shorter that it
consists of have reached the threshold, wherever in the circle that happens, and is then counted for one full
cycle, so each of its shards is counted once. Steps end one cycle after the last activation. The shards are
written once and each step reads one of them.

What is active is told to the tasks by a table of ``SLOTS`` bytes, the same size for any corpus: the slot of
a phrase's hash holds the earliest step at which a phrase of that slot reached the threshold. Once a slot is taken its phrases
are counted no further, since nothing more follows from their counts. Between steps a phrase is one number: 40 bits
of its hash, its length and its step of activation, which keeps what is shuffled narrow. A phrase that shares
its hash or slot with others may be activated before its time or taken for frequent, never the reverse. One last
scan therefore counts, by the words themselves, the phrases whose slots and whose parts' slots are taken, so
collisions change no result. A table that fills up prunes less, which costs time and what the last scan shuffles.
Each step's table takes the place of the one before, without the phrases whose cycle has ended, and what a step
shuffled is removed at its end.

Tasks count with numpy what Spark deals out and Spark sums it: a task turns a bounded piece of text into
word numbers and hashes, and writes the counts of the active phrases of that piece.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; an
empty table has no phrases. A text of any length is read in pieces of ``PIECE`` bytes cut at piece
ends, so a task's memory does not grow with it, unless one piece is longer. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm import words as B
from lagwise.operators.lookup import BROADCAST_KEYS, lookup_join
from lagwise.session import fresh_path, remove, replace_stored

SLOTS = 1 << 23
LATER = 255
#: A slot that only phrases of ``MOST_WORDS`` words have reached: it activates nothing and is still open to shorter ones.
LONGEST = 254
CHUNK = 1 << 16
MOST_WORDS = 4
#: ``h``: the phrase's number, see ``_number``
STEP_SCHEMA = "h long, n long"
HASH_BITS = 40
SINCE_BIT = HASH_BITS + 2
SCHEMA = "lang string, length int, phrase string, n long"
#: Bytes of text that a task looks at together; larger pieces leave fewer rows to sum.
PIECE = 2 << 20
UNKNOWN = "und"

#: Class of each byte: 0 between pieces, 1 between words, 2 in a word.
_KINDS = np.full(256, 2, dtype=np.uint8)
_KINDS[np.frombuffer(b" \t", dtype=np.uint8)] = 1
_KINDS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)] = 0
_PIECE_END = _KINDS == 0
#: Words of more bytes are hashed one by one.
SHORT = 64
#: The first 0 to 8 of eight bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts of texts in them, number of their text): whole texts, or parts of a long one cut at a piece's end."""
    for at, stop in B.pieces(ends, PIECE, 1 << 16):
        low, high = int(ends[at]), int(ends[stop])
        while high - low > 2 * PIECE:
            cut = low + PIECE
            while cut < high:
                stops = np.flatnonzero(_PIECE_END[data[cut : min(cut + PIECE, high)]])
                if len(stops):
                    cut += int(stops[0]) + 1
                    break
                cut = min(cut + PIECE, high)
            yield data[low:cut], np.zeros(1, dtype=np.int64), np.array([at])
            low = cut
        starts = np.maximum(ends[at:stop] - low, 0)
        yield data[low:high], starts, np.arange(at, stop)


def _word_column(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as one Arrow column, without a Python object per word."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[begin] += 1
    inside[end] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())])


def _number(hashes: np.ndarray, length: int, since: np.ndarray) -> np.ndarray:
    """Numbers of phrases: the low bits of the hash, which hold the slot, then length - 1, then the step of activation."""
    low = hashes & np.uint64((1 << HASH_BITS) - 1)
    return low | np.uint64((length - 1) << HASH_BITS) | since.astype(np.uint64) << np.uint64(SINCE_BIT)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Slots of a table whose size is a power of two."""
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def lang_seed(lang: str) -> np.uint64:
    codes = np.frombuffer(lang.encode(), dtype=np.uint8).astype(np.uint64)
    return B.sequence_hash(codes + np.uint64(1))


def combined(words: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """Hash of phrases whose first, second, ... words have these hashes, in their language."""
    total = seed * np.uint64(2 * len(words) + 1)
    for k, word in enumerate(words):
        total = total + word * B._MULTIPLIERS[k]
    return B.mix(total)


def _byte_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hash of each value of a column of byte strings."""
    _, offsets, buffer = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return _word_hashes(data, ends[:-1], ends[1:])


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, of eight bytes at a time; the bytes of words over ``SHORT`` are first summed up to one number."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - begin
    total = B.mix(eights[begin] & _MASKS[np.minimum(size, 8)])
    more = np.flatnonzero((size > 8) & (size <= SHORT))
    for at in range(8, SHORT, 8):
        more = more[size[more] > at]
        total[more] = B.mix(total[more] + (eights[begin[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]) * B._MULTIPLIERS[0])
    for k in np.flatnonzero(size > SHORT).tolist():
        word = data[begin[k] : end[k]]
        total[k] = (B._CODES[word] * B._power_tables(len(word))[0][: len(word)]).sum(dtype=np.uint64)
    return B.mix(total + size.astype(np.uint64) * B._MULTIPLIERS[1])


class Piece:
    """Words of a stretch of text: their hashes, languages and whether phrases of them are whole."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, texts: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        text = data.tobytes()
        self.lowered = np.frombuffer(text.translate(B._LOWER.tobytes()), dtype=np.uint8)
        kinds = np.frombuffer(text.translate(_KINDS.tobytes()), dtype=np.uint8)
        kind = np.zeros(len(data) + 2, dtype=bool)
        kind[1:-1] = kinds == 2
        joined = kind[1:] & kind[:-1]
        joined[starts[starts < len(data)]] = False
        self.begin = np.flatnonzero(kind[1:-1] & ~joined[:-1])
        self.end = np.flatnonzero(kind[1:-1] & ~joined[1:]) + 1
        of_text = np.searchsorted(starts, self.begin, side="right") - 1
        before = np.searchsorted(self.begin, np.flatnonzero(kinds == 0))  # words before each piece's end
        self.part = np.repeat(np.arange(len(before) + 1), np.diff(before, prepend=0, append=len(self.begin))) + of_text
        self.hash = _word_hashes(self.lowered, self.begin, self.end)
        self.lang = langs[texts[of_text]]
        self.seed = seeds[self.lang]

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words and the number of each place's word among them."""
        coded = _word_column(self.lowered, self.begin, self.end).dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)

    def hashes(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each place on; the last places have none."""
        last = max(len(self.hash) - length + 1, 0)
        return combined([self.hash[k : last + k] for k in range(length)], self.seed[:last])

    def whole(self, length: int) -> np.ndarray:
        """Whether the ``length`` words from each place on stand in one piece of one text."""
        last = max(len(self.part) - length + 1, 0)
        return self.part[:last] == self.part[length - 1 :]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Piece, list[str]]]:
    """The pieces of Arrow batches of (lang, text) with the names of their languages."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        langs = batch.column(0).dictionary_encode()
        names = [*langs.dictionary.to_pylist(), UNKNOWN]
        own = np.asarray(langs.indices.fill_null(len(names) - 1), dtype=np.int64)
        seeds = np.array([lang_seed(n) for n in names], dtype=np.uint64)
        data, ends = B.text_bytes(batch.column(1))
        for stretch in _stretches(data, ends):
            yield Piece(*stretch, own, seeds), names


def count_step(
    batches: Iterator[pa.RecordBatch], step: int, cycle: int, reached: np.ndarray, all_active: bool = True
) -> Iterator[pa.RecordBatch]:
    """(number, n, since, length) of the phrases that are active at this step, or of those whose slots are not yet taken."""
    for piece, _ in _read(batches):
        # the step since which each place's phrase is active, LATER where it is not or is cut by a piece's end
        since, hashes = np.zeros(len(piece.hash), dtype=np.uint8), piece.hashes(1)
        for length in range(1, MOST_WORDS + 1):
            if length > 1:
                shorter = np.maximum(since, taken)
                since, hashes = np.maximum(shorter[:-1], shorter[1:]), piece.hashes(length)
                since[~piece.whole(length)] = LATER
            active = since <= step
            if not active.any():
                break  # a longer phrase is never active before its parts
            taken = reached[_slot(hashes, len(reached))]
            active &= since >= max(step - cycle + 1, 0)
            places = np.flatnonzero(active if all_active else active & (taken >= (LONGEST if length < MOST_WORDS else LATER)))
            if len(places):
                numbers = np.sort(_number(hashes[places], length, since[places]))
                begins = np.flatnonzero(np.diff(numbers, prepend=~numbers[0]))
                first = numbers[begins]
                columns = [
                    pa.array(first.view(np.int64)), pa.array(np.diff(begins, append=len(numbers)).astype(np.int64)),
                    pa.array((first >> np.uint64(SINCE_BIT)).astype(np.int32)), pa.array(np.full(len(first), length, dtype=np.int32)),
                ]
                yield pa.record_batch(columns, names=["h", "n", "since", "length"])


def count_taken(batches: Iterator[pa.RecordBatch], reached: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, length, phrase, n) of the phrases whose slots and parts are taken, and each language's words as length 0."""
    for piece, names in _read(batches):
        totals = np.bincount(piece.lang, minlength=len(names))
        yield pa.record_batch(
            [pa.array(names, pa.string()), pa.array(np.zeros(len(names), dtype=np.int32)), pa.array([""] * len(names)), pa.array(totals)],
            names=["lang", "length", "phrase", "n"],
        )
        texts, code = piece.coded()
        texts = texts.cast(pa.large_string())
        for length in range(1, MOST_WORDS + 1):
            own = reached[_slot(piece.hashes(length), len(reached))] != LATER
            # a frequent phrase has frequent parts, so what shares a frequent phrase's slot by chance seldom passes
            taken = own if length == 1 else own & taken[:-1] & taken[1:] & piece.whole(length)
            places = np.flatnonzero(taken)
            if not len(places):
                break
            key, bound = piece.lang[places], len(names)
            for k in range(length):
                if bound * len(texts) >= 1 << 63:  # made dense, so that keys never pass 64 bits
                    key = np.unique(key, return_inverse=True)[1]
                    bound = len(key)
                key = key * len(texts) + code[places + k]
                bound *= len(texts)
            order = np.argsort(key)
            begins = np.flatnonzero(np.diff(key[order], prepend=-1))
            first, counts = places[order[begins]], np.diff(begins, append=len(order))
            words = [texts.take(pa.array(code[first + k])) for k in range(length)]
            phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if length > 1 else words[0]
            columns = [
                pa.array(names, pa.string()).take(pa.array(piece.lang[first])), pa.array(np.full(len(first), length, dtype=np.int32)),
                phrase.cast(pa.string()), pa.array(counts.astype(np.int64)),
            ]
            yield pa.record_batch(columns, names=["lang", "length", "phrase", "n"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bits of its slots): one row per chunk of this partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        slots, chunks = (np.asarray(c) for c in batch.columns)
        for chunk in np.unique(chunks).tolist():
            held.setdefault(chunk, np.zeros(CHUNK, dtype=np.uint8))[slots[chunks == chunk] % CHUNK] = 1
    for chunk, bits in held.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["chunk", "bits"])


def _mark(reached: np.ndarray, frequent: DataFrame, step: int) -> bool:
    """Enter ``step`` in the still empty slots of these phrase numbers; whether longer phrases may follow from them."""
    slot = F.col("h").bitwiseAND(F.lit(len(reached) - 1)).cast("int")
    longest = (F.shiftright("h", HASH_BITS).bitwiseAND(F.lit(3)) == MOST_WORDS - 1).cast("int")
    slots = frequent.select(slot.alias("slot"), ((slot / CHUNK).cast("int") * 2 + longest).alias("chunk"))
    maps = slots.repartition("chunk").mapInArrow(_bitmaps, "chunk int, bits binary")
    found = False
    for row in maps.collect():  # at most 2 * SLOTS / CHUNK rows of CHUNK bits
        at, last = divmod(row["chunk"], 2)
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)
        own = reached[at * CHUNK : (at + 1) * CHUNK]
        fresh = bits & (own >= (LATER if last else LONGEST))
        own[fresh] = LONGEST if last else step
        found |= not last and bool(fresh.any())
    return found


def phrase_counts(
    docs: DataFrame, threshold: int, shards: int = 4, text: str = "text", lang: str = "lang", slots: int = SLOTS
) -> DataFrame:
    """(lang, length, phrase, n) of all phrases of 1 to 4 words that occur ``threshold`` times.

    A row of length 0 has the number of all words of its language. ``slots`` is a power of two of at least
    CHUNK; four cycles of ``shards`` steps must stay below 254.
    """
    spark = docs.sparkSession
    staged = fresh_path(spark, "phrase-shards")
    shard = F.pmod(F.xxhash64(text), F.lit(shards)).cast("int")
    docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), shard.alias("shard")).write.partitionBy("shard").parquet(staged)
    rows = spark.read.schema("lang string, text string, shard int").parquet(staged)
    context, reached = spark.sparkContext, np.full(slots, LATER, dtype=np.uint8)
    open_counts, stored = None, None
    step, last = 0, shards - 1
    while step <= last:
        told = context.broadcast(reached)
        run = (lambda table, now: lambda batches: (b.select([0, 1]) for b in count_step(batches, now, shards, table.value, False)))(told, step)
        found = rows.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(run, STEP_SCHEMA)
        if open_counts is not None:
            found = found.unionByName(open_counts)
        # what has reached the threshold, or is yet to reach it and still in its cycle
        frequent, still = F.col("n") >= threshold, F.shiftright("h", SINCE_BIT) + shards > step + 1
        counts, stored = replace_stored(found.groupBy("h").agg(F.sum("n").alias("n")).where(frequent | still), "phrases-open", stored)
        told.destroy()
        if _mark(reached, counts.where(frequent), step + 1):
            last = step + shards
        open_counts = counts.where(~frequent)
        step += 1
    told = context.broadcast(reached)
    taken = rows.select("lang", "text").mapInArrow(lambda batches: count_taken(batches, told.value), SCHEMA)
    total = taken.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))
    found, _ = replace_stored(total.where((F.col("length") == 0) | (F.col("n") >= threshold)), "phrases", stored)
    told.destroy()
    remove(spark, staged)
    return found


def scored(counts: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase, length, a, l, r, score) of every phrase of two words or more, by its lowest-scoring cut."""
    parts = counts.where((F.col("n") >= threshold) & F.col("length").between(1, MOST_WORDS - 1)).select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = (
        counts.where((F.col("length") > 1) & (F.col("n") >= threshold))
        .select("lang", "phrase", "length", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
        .withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("length") - F.col("k")), " "))
    )
    small = parts.count() <= BROADCAST_KEYS // 2
    for side, name in (("left", "l"), ("right", "r")):
        # a part of count n begins (ends) at most 3 n / threshold phrases, so the largest n are the hot keys
        part = parts.select("lang", F.col("phrase").alias(side), F.col("n").alias("_weight"), F.col("n").alias(name))
        cuts = lookup_join(cuts, part, ["lang", side], "phrase", "_weight", small)
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    lowest = cuts.select("lang", "phrase", "length", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = lowest.groupBy("lang", "phrase").agg(F.first("length").alias("length"), F.first("a").alias("a"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "length", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def maximal(found: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases that stand in no longer phrase with ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    inner = found.where(F.col("length") > 2).select(
        "lang", F.col("a").alias("_longer"), words.alias("_words"), F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("_size")
    )
    inner = inner.select(
        "lang", "_longer", "_words", "_size", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("_size") + 1)).alias("_at")
    ).select("lang", "_longer", F.array_join(F.slice("_words", F.col("_at"), F.col("_size")), " ").alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    hundred = lambda column: F.col(column).cast("decimal(19,0)")
    kept = found.join(longest, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (hundred("_longer") * 100 < hundred("a") * percent)
    )
    return kept.drop("_longer")


def collocations(
    docs: DataFrame, threshold: int = 30, top: int = 2000, percent: int = 80, shards: int = 4, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and spelling."""
    counts = phrase_counts(docs, threshold, shards, text, lang)
    totals = counts.where(F.col("length") == 0).select("lang", "n")
    kept = maximal(scored(counts, threshold), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of many parts hold the first of all, so no language is sorted in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("_part", part).withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order)))
    ranked = few.where(F.col("_rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
