"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. The shingles of a window (``shingle`` words each, or the whole window if it is shorter) are
ordered by rarity, which is the number of documents that hold them. A document can only hold a
share ``share`` of a window's shingles if it holds one of the window's ``n - ceil(share * n) + 1``
rarest: only these are joined. Each meeting fixes the place where the window would have to start;
windows that would begin before the document or end after it are left out (length and position
bounds), and the rest is verified shingle by shingle at its place.

Two passes over the documents, no shuffle of texts. Items are taken in blocks of ``block_bytes`` of
text, so that what is broadcast is bounded whatever the size of the benchmark; every block sees
every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm import words as W
from lagwise.llm.columns import apart
from lagwise.session import materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

N_WORDS, SPANS, ITEMS = "_n_words", "_spans", "_items"
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_FOUND = [T.StructField(N_WORDS, T.LongType()), T.StructField(SPANS, _SPAN), T.StructField(ITEMS, T.ArrayType(T.StringType()))]


def words_of(text: str | None) -> list[str]:
    """Words of one text: A-Z lower-cased, runs of digits, letters and non-ASCII code points."""
    return WORD.findall((text or "").translate(_LOWER))


class Windows(NamedTuple):
    """Distinct windows of one length, as rows of shingle numbers, with the items that hold them."""

    length: int  # words
    size: int  # words of a shingle
    shingles: np.ndarray  # windows x shingles of each
    items: list[list[str]]


class Block(NamedTuple):
    """The windows of a block of items and the hashes of their shingles by shingle size."""

    windows: list[Windows]
    known: dict[int, np.ndarray]  # sorted hashes


def build_block(items: list[tuple[str, str]], window: int, shingle: int) -> Block:
    """Windows of the given (item id, text) rows. Bounded by the size of the block."""
    held: dict[tuple[str, ...], set[str]] = {}
    for item_id, text in items:
        found = words_of(text)
        if found:
            length = min(window, len(found))
            for at in range(len(found) - length + 1):
                held.setdefault(tuple(found[at : at + length]), set()).add(item_id)
    by_length: dict[int, list[tuple[tuple[str, ...], set[str]]]] = {}
    for key, ids in held.items():
        by_length.setdefault(len(key), []).append((key, ids))
    hashed, known = [], {}
    for length, rows in sorted(by_length.items()):
        size = min(shingle, length)
        texts = pa.array([" ".join(key) for key, _ in rows], type=pa.string())
        values = np.concatenate([W.shingles(f, size)[1] for f in W.words(texts, W.ALPHANUMERIC)])
        hashed.append((length, size, values.reshape(len(rows), length - size + 1), [sorted(ids) for _, ids in rows]))
        known[size] = np.union1d(known.get(size, np.zeros(0, dtype=np.uint64)), values)
    windows = [Windows(n, size, np.searchsorted(known[size], values), ids) for n, size, values, ids in hashed]
    return Block(windows, known)


def _match(found: W.Words, size: int, known: np.ndarray) -> np.ndarray:
    """Number of the known shingle that starts at each word of a piece, -1 where none does."""
    numbers = np.full(len(found.hash), -1, dtype=np.int64)
    at, values = W.shingles(found, size)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    same = known[place] == values
    numbers[at[same]] = place[same]
    return numbers


def _document_counts(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    """For each known shingle, how many texts of the partition hold it."""
    known = block.value.known
    totals = {size: np.zeros(len(values), dtype=np.int64) for size, values in known.items()}
    for batch in batches:
        for found in W.words(batch.column(0), W.ALPHANUMERIC):
            for size, values in known.items():
                numbers = _match(found, size, values)
                at = np.flatnonzero(numbers >= 0)
                pairs = np.unique(found.text[at] * len(values) + numbers[at])
                totals[size] += np.bincount(pairs % len(values), minlength=len(values))
    for size, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(at), pa.array(total[at])], names=["size", "shingle", "n"]
        )


class Probes(NamedTuple):
    """Prefix shingles of the windows of one length, ordered by shingle."""

    windows: Windows
    need: int
    shingle: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def choose_prefixes(block: Block, counts: dict[int, np.ndarray], share: float) -> list[Probes]:
    """The rarest shingles of every window: as many as an occurrence cannot do without."""
    probes = []
    for w in block.windows:
        each = w.shingles.shape[1]
        need = max(1, int(np.ceil(share * each - 1e-9)))
        rarity = counts[w.size][w.shingles]
        order = np.argsort(rarity, axis=1, kind="stable")[:, : each - need + 1]
        window = np.repeat(np.arange(len(order)), order.shape[1])
        offset = order.ravel()
        shingle = w.shingles[window, offset]
        by = np.argsort(shingle, kind="stable")
        probes.append(Probes(w, need, shingle[by], window[by], offset[by]))
    return probes


def _occurrences(found: W.Words, probes: list[Probes], known: dict[int, np.ndarray]) -> Iterator[tuple[Probes, np.ndarray, np.ndarray]]:
    """(probes, window, first word) of every verified window of a piece."""
    matched = {size: _match(found, size, values) for size, values in known.items()}
    counts = found.counts()
    stop = np.cumsum(counts)
    begin = stop - counts
    for p in probes:
        numbers = matched[p.windows.size]
        at = np.flatnonzero(numbers >= 0)
        low = np.searchsorted(p.shingle, numbers[at])
        each = np.searchsorted(p.shingle, numbers[at], side="right") - low
        at, low, each = at[each > 0], low[each > 0], each[each > 0]
        # a shingle may be the prefix of many windows: take a bounded number of meetings at a time
        ends, done = np.cumsum(each), 0
        while done < len(at):
            upto = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + W.PIECE, side="right"))
            upto = max(upto, done + 1)
            some = each[done:upto]
            first = np.repeat(np.cumsum(some) - some, some)
            probe = np.repeat(low[done:upto], some) + np.arange(int(some.sum())) - first
            place = np.repeat(at[done:upto], some)
            start, window = place - p.offset[probe], p.window[probe]
            text = found.text[place]
            fits = (start >= begin[text]) & (start + p.windows.length <= stop[text])
            start, window = start[fits], window[fits]
            agree = np.zeros(len(start), dtype=np.int64)
            for k in range(p.windows.shingles.shape[1]):
                agree += numbers[start + k] == p.windows.shingles[window, k]
            good = agree >= p.need
            if good.any():
                yield p, window[good], start[good]
            done = upto


def _piece_result(found: W.Words, probes, known) -> tuple[np.ndarray, list, list]:
    """Per text of a piece: number of words, merged spans of hit words, ids of occurring items."""
    counts = found.counts()
    begin = np.cumsum(counts) - counts
    change = np.zeros(len(found.hash) + 1, dtype=np.int64)
    items: list[set[str] | None] = [None] * found.texts
    for p, window, start in _occurrences(found, probes, known):
        np.add.at(change, start, 1)
        np.add.at(change, start + p.windows.length, -1)
        for pair in np.unique(found.text[start] * len(p.windows.items) + window):
            text, w = divmod(int(pair), len(p.windows.items))
            items[text] = (items[text] or set()) | set(p.windows.items[w])
    hit = np.zeros(len(found.hash) + 2, dtype=bool)
    hit[1:-1] = np.cumsum(change[:-1]) > 0
    # a span ends with its text even if the next text goes on with a hit word
    edge = np.zeros(len(found.hash) + 1, dtype=bool)
    edge[begin[counts > 0]] = True
    first = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
    edge[-1] = True
    last = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:])) + 1
    spans: list[list[dict]] = [[] for _ in range(found.texts)]
    for a, b in zip(first.tolist(), last.tolist()):
        text = int(found.text[a])
        spans[text].append({"start": a - int(begin[text]), "stop": b - int(begin[text])})
    return counts, spans, items


def _merge(one: list[dict] | None, other: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for s in sorted([*(one or []), *other], key=lambda s: (s["start"], s["stop"])):
        if merged and s["start"] <= merged[-1]["stop"]:
            merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
        else:
            merged.append(dict(s))
    return merged


def _search(batches: Iterator[pa.RecordBatch], text_column: str, block, probes) -> Iterator[pa.RecordBatch]:
    """Each row with its number of words and what earlier blocks and this one have found in it."""
    kinds = {f.name: pa.int64() if f.name == N_WORDS else None for f in _FOUND}
    kinds[SPANS] = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds[ITEMS] = pa.list_(pa.string())
    for batch in batches:
        n_words, spans, items = [], [], []
        for found in W.words(batch.column(batch.schema.get_field_index(text_column)), W.ALPHANUMERIC):
            counts, new_spans, new_items = _piece_result(found, probes.value, block.value.known)
            n_words.append(counts)
            spans += new_spans
            items += new_items
        names = batch.schema.names
        if N_WORDS in names:
            spans = [_merge(a, b) if b else a for a, b in zip(batch.column(names.index(SPANS)).to_pylist(), spans)]
            items = [sorted({*a, *(b or ())}) for a, b in zip(batch.column(names.index(ITEMS)).to_pylist(), items)]
        items = [sorted(x or ()) for x in items]
        kept = [(n, batch.column(k)) for k, n in enumerate(names) if n not in kinds]
        added = [
            pa.array(np.concatenate(n_words) if n_words else [], type=kinds[N_WORDS]),
            pa.array(spans, type=kinds[SPANS]), pa.array(items, type=kinds[ITEMS]),
        ]
        yield pa.record_batch([c for _, c in kept] + added, names=[n for n, _ in kept] + list(kinds))


def find_windows(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    share: float = 1.0,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``documents`` with ``_n_words``, ``_spans`` (hit words, merged, from 0) and ``_items``.

    Null and empty texts have no words and no hits. Items without words or with a null text occur
    nowhere; a null item id counts as the id ``null``. Repeated rows are treated one by one, and
    repeated items count once per id. Columns of ``documents`` are kept; those named like a result
    are replaced.
    """
    spark = documents.sparkSession
    documents = documents.drop(N_WORDS, SPANS, ITEMS)
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    schema = T.StructType([*documents.schema.fields, *_FOUND])
    result = documents
    for number in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        block = build_block([(r.item, r.text) for r in mine.collect()], window, shingle)
        shared = spark.sparkContext.broadcast(block)
        counted = (
            documents.select(text)
            .mapInArrow(lambda b, shared=shared: _document_counts(b, shared), "size int, shingle long, n long")
            .groupBy("size", "shingle").agg(F.sum("n").alias("n"))
        )
        counts = {size: np.zeros(len(values), dtype=np.int64) for size, values in block.known.items()}
        for row in counted.collect():  # one row per shingle of the block at most
            counts[row["size"]][row["shingle"]] = row["n"]
        probes = spark.sparkContext.broadcast(choose_prefixes(block, counts, share))
        if number:
            result = materialize(result, "decontaminate")
        result = result.mapInArrow(lambda b, s=shared, p=probes: _search(b, text, s, p), schema)
    return result


def contaminated(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_windows(documents.select("doc_id", "text"), benchmark, **settings)
    hit = F.aggregate(SPANS, F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        F.col(N_WORDS).alias("n_words"),
        hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    documents, restore = apart(documents, N_WORDS, SPANS, ITEMS)
    found = find_windows(documents, benchmark, **settings)
    return restore(found.where(F.size(SPANS) == 0).select(*[F.col(f"`{c}`") for c in documents.columns]))
