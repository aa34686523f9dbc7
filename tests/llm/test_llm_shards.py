import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lagwise.llm import histogram_shards as H
from lagwise.llm import queries
from llm_data import empty_documents, odd_documents, odd_rows, prose


def check(rows, shards, largest):
    """Shards are consecutive in (text hash, id) order, gapless, and near equal in bytes."""
    rows = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.key for r in rows] == sorted(r.key for r in rows)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    for s in range(shards):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    assert max(sizes) - min(sizes) <= 2 * largest + 0.004 * sum(sizes) / shards
    return sizes


def keyed(df):
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    return df.select("shard", "slot", (F.octet_length(text) + 1).alias("size"), F.struct(F.xxhash64(text).alias("t"), "doc_id").alias("key"))


@pytest.mark.parametrize("shards, piece_bytes", [(8, 1 << 25), (3, 2000), (1, 500)])
def test_near_equal_with_a_hot_group(spark, shards, piece_bytes):
    rows = [(k, prose(k, 5 + k % 60)) for k in range(600)] + [(1000 + k, prose(7, 40)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = keyed(H.shard_by_bytes(df, shards, piece_bytes=piece_bytes)).collect()
    assert len(found) == len(rows)
    check(found, shards, max(len(t) for _, t in rows))


def test_odd_rows(spark):
    df = odd_documents(spark)
    found = H.shard_by_bytes(df, 4)
    assert sorted(found.columns) == sorted(df.columns)
    assert len(found.collect()) == len(odd_rows())
    for s in range(4):
        slots = sorted(r.slot for r in found.where(f"shard = {s}").collect())
        assert slots == list(range(len(slots)))
    assert H.shard_by_bytes(empty_documents(spark), 4).collect() == []


def test_whole_table(spark, folder):
    found = queries.QUERIES["op2_histogram_shards"](spark, folder)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_buckets_are_those_of_bisection():
    import bisect

    random = np.random.default_rng(1)
    probes = sorted({(int(a), int(b)) for a, b in random.integers(0, 9, (20, 2))})
    keys = [(int(a), int(b)) for a, b in random.integers(0, 9, (200, 2))]
    found = H._bucket(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array(probes))
    assert found.tolist() == [bisect.bisect_right(probes, k) for k in keys]


def rounds_in_memory(text_keys, row_keys, sizes, wanted):
    """``find_splitters`` without Spark: the rounds of the driver over one histogram."""
    brackets = [H.Bracket(t, tolerance, int(sizes.sum()), len(sizes)) for t, tolerance in wanted]
    open_ones, spent, largest = list(brackets), 0.0, 0
    while open_ones:
        start = time.process_time()
        tried = H._next_probes(open_ones, 48)
        spent += time.process_time() - start
        largest = max(largest, len(tried))
        grid = np.array(tried, dtype=np.int64)
        batch = pa.record_batch([pa.array(text_keys), pa.array(row_keys), pa.array(sizes)], names=["t", "r", "s"])
        table = pa.Table.from_batches(list(H._histogram(iter([batch]), grid)))
        start = time.process_time()
        counts = H.Counts(table, len(tried))
        for b in open_ones:
            b.narrow(tried, counts)
        open_ones = [b for b in open_ones if not b.found]
        spent += time.process_time() - start
    return brackets, spent, largest


def test_splitters_have_exact_counts_and_meet_their_tolerance():
    random = np.random.default_rng(3)
    text_keys = random.integers(H.LEAST, H.MOST, 20_000)
    text_keys[:7000] = text_keys[0]  # a third of all rows is one text
    row_keys, sizes = np.arange(20_000), random.integers(1, 900, 20_000)
    wanted = [(sizes.sum() * k / 300, 0.2 * sizes.sum() / 300) for k in range(1, 300)]
    brackets, _, _ = rounds_in_memory(text_keys, row_keys, sizes, wanted)
    keys = list(zip(text_keys.tolist(), row_keys.tolist()))
    for b in brackets:
        below = np.array([k < b.splitter for k in keys])
        assert b.below == (sizes[below].sum(), below.sum())
        assert abs(b.below[0] - b.target) <= max(b.tolerance, sizes.max())


def test_the_last_row_may_hold_most_bytes():
    text_keys, row_keys, sizes = np.arange(100), np.arange(100), np.ones(100, dtype=np.int64)
    sizes[99] = 10_000
    brackets, _, _ = rounds_in_memory(text_keys, row_keys, sizes, [(10_099 * k / 4, 1.0) for k in range(1, 4)])
    assert [b.below for b in brackets] == [(99, 99)] * 2 + [(10_099, 100)]
    assert brackets[2].splitter is None or brackets[2].splitter > (99, 99)


def test_one_very_long_text_among_short_ones(spark):
    rows = [(k, f"short {k}") for k in range(40)] + [(99, "long " * 400_000)]
    found = keyed(H.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4)).collect()
    assert len(found) == 41
    check(found, 4, 2_000_001)


def test_driver_work_grows_with_the_pieces():
    random = np.random.default_rng(4)
    text_keys, row_keys, sizes = random.integers(H.LEAST, H.MOST, 400_000), np.arange(400_000), np.ones(400_000, dtype=np.int64)
    pieces = 20_000
    wanted = [(400_000 * k / pieces, 0.2 * 400_000 / pieces) for k in range(1, pieces)]
    brackets, spent, largest = rounds_in_memory(text_keys, row_keys, sizes, wanted)
    print(f"{pieces} pieces: {spent:.1f} s in the driver, {largest} candidates at most")
    assert largest <= H.GRID + 2 * pieces
    assert spent < 20  # quadratic work took 43 s for 4,000 pieces
