"""Lines that many documents share, found by levelled sorted runs of line hashes, and dropped.

A line's key is the line without blanks at both ends and with A-Z lower-cased. ``LineRuns`` takes
documents batch by batch and keeps, per key, the number of documents that hold it:

* a batch is counted per key with partial sums before the shuffle, which lays it out like the runs;
* keys that a run already counts as common are settled, so the batch is merge-anti-joined with the
  runs and adds only its other keys as a new sorted run of level 0;
* a level that holds ``fanout`` runs is compacted into one run of the next level, so a key is
  rewritten once per level.

Runs are Parquet tables in the shared folder, bucketed and sorted by the key's hash. Anti-joins and
compactions are merge joins bucket by bucket: no run is ever shuffled, and a batch is shuffled once,
after it has been counted. A key is two 64-bit hashes of independent seeds; keys are distinct within a
document before they are counted. Everything is DataFrame functions.

Dropping looks every line up in the common keys. Few keys are broadcast after a count; of many, the
most frequent thousand are, and their lines are salted (``lookup_join``). The positions to drop come
back to the document by the hash of its id and text.

Edge cases: a null or empty text is one empty line, which has no key as long as ``min_chars`` is 1 or
more, and stays. Repeated rows count as documents of their own and lose the same lines. A null doc_id
is an id like any other. An empty table gives no rows. Columns named like those used here keep their
names and values. A very long text is split into its lines within one row, so a task holds a few times
its size; the lines to drop are matched by position, in time linear in the number of lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.columns import apart
from lagwise.operators.lookup import BROADCAST_KEYS, lookup_join
from lagwise.session import fresh_path, materialize

BLANKS = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["_h1", "_h2"]
ROW = ["_r1", "_r2"]


def _hashes(seeds: tuple[int, int], *columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in seeds]


def key_hash(key: Column) -> list[Column]:
    return [h.alias(n) for h, n in zip(_hashes((11, 12), key), KEY)]


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order; texts of ASCII alone take the faster lower-casing."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, UPPER.lower())
    )
    return F.transform(F.split(lowered, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, text: str = "text", min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, key hash): one row per document and distinct key of at least ``min_chars``."""
    keys = docs.select(*keep, F.explode(F.array_distinct(line_keys(F.col(text)))).alias("_key"))
    return keys.where(F.char_length("_key") >= min_chars).select(*keep, *key_hash(F.col("_key")))


class LineRuns:
    """Counts of documents per line key over all batches added so far."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        """The runs of all levels, newest level first."""
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, counts: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        (
            counts.select(*KEY, "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", fresh_path(self.spark, "line-run")).saveAsTable(name)
        )
        return name

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """Rows of (key, n) whose key no run counts as common yet."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select(*KEY), KEY, "left_anti")
        return counts

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of the sums of several."""
        def two(left: DataFrame, right: DataFrame) -> DataFrame:
            other = right.withColumnRenamed("n", "_m")
            both = F.coalesce("n", F.lit(0)) + F.coalesce("_m", F.lit(0))
            return left.join(other, KEY, "full").select(*KEY, both.alias("n"))

        return reduce(two, runs)

    def add(self, lines: DataFrame) -> None:
        """Add a batch: the rows of ``line_hashes`` of documents that no earlier batch held."""
        counts = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        self._put(0, self._write(self.unsettled(counts)))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        held.append(name)
        if len(held) < self.fanout:
            return
        merged = self._write(self._merged([self.spark.table(n) for n in held]))
        for old in held:
            self.spark.sql(f"DROP TABLE {old}")
        held.clear()
        self._put(level + 1, merged)

    def common(self) -> DataFrame:
        """(key, n) of all keys in at least ``min_docs`` documents; n stops growing once that is known."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "_h1 long, _h2 long, n long")
        return self._merged(runs).where(F.col("n") >= self.min_docs)

    def close(self) -> None:
        """Forget the runs; their files stay until the stored steps are removed."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, text: str = "text") -> DataFrame:
    """(key hash, n) of the lines in at least ``min_docs`` rows, stored in the shared folder.

    The hashes of all lines are written once, by batch; each batch is then read alone.
    """
    spark = docs.sparkSession
    staged = fresh_path(spark, "lines")
    batch = F.pmod(F.xxhash64(text), F.lit(batches)).cast("int")
    rows = docs.select(text, batch.alias("_batch"))
    line_hashes(rows, text, min_chars, keep=("_batch",)).write.partitionBy("_batch").parquet(staged)
    lines = spark.read.schema("_h1 long, _h2 long, _batch int").parquet(staged)
    runs = LineRuns(spark, min_docs)
    for number in range(batches):
        runs.add(lines.where(F.col("_batch") == number).select(*KEY))
    found = materialize(runs.common(), "common-lines")
    runs.close()
    return found


def without_lines(
    docs: DataFrame, common: DataFrame, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", small: bool | None = None
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` after the lines of ``common`` are gone.

    ``kept_text`` joins the other lines by line breaks. ``small`` tells whether the common keys
    may be broadcast whole; by default they are counted.
    """
    names = ["_lines", "_dropped", *KEY, *ROW, "kept_text", "n_lines", "n_dropped"]
    own, restore = apart(docs, *names)
    away = {old: new for old, new in zip(docs.columns, own.columns)}
    text, doc_id = away[text], away[doc_id]
    if small is None:
        small = common.count() <= BROADCAST_KEYS // 2
    row = [h.alias(n) for h, n in zip(_hashes((13, 14), F.col(doc_id), F.col(text)), ROW)]
    # the row's hashes stand below the explode, so a text is hashed once and not once a line
    places = own.select(*row, text).select(*ROW, F.posexplode(line_keys(F.col(text))).alias("_at", "_key"))
    places = places.where(F.char_length("_key") >= min_chars).select(*ROW, "_at", *key_hash(F.col("_key")))
    marked = lookup_join(places, common.select(*KEY, "n", F.lit(True).alias("_common")), KEY, "_r1", "n", small)
    dropped = (
        marked.where("_common").groupBy(*ROW).agg(F.collect_set("_at").alias("_dropped"))
        .withColumnsRenamed({n: f"{n}_d" for n in ROW})
    )
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    found = own.select(*own.columns, *row, lines.alias("_lines")).join(
        dropped, [F.col(n) == F.col(f"{n}_d") for n in ROW], "left"
    )
    gone = F.coalesce("_dropped", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    return restore(
        found.select(
            *own.columns,
            F.array_join(F.transform(stay, lambda at: F.get("_lines", at)), "\n").alias("kept_text"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
        )
    )


def without_common_lines(
    docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with the text that is left once lines of at least ``min_docs`` documents are dropped."""
    return without_lines(docs, common_lines(docs, min_docs, min_chars, batches, text), min_chars, text, doc_id)
