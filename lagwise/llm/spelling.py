"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are counted over all documents. Each frequent word, between two end marks, then gets one gram for
every place: the shortest gram from there on that at most ``frequent`` places of the whole vocabulary
share, between ``SHORTEST`` and ``LONGEST`` signs long. The gram dictionary is thereby pruned by frequency:
a longer gram is in it only where the shorter one is too frequent to be a useful list. Because a gram's
length depends on its own signs alone, an edit changes only the grams that cover it.

A word's affected-gram bound is the largest number of its grams that one edit can cover. Of two words one
edit apart, the unaffected grams are the same, stand at the same distance from the left or the right end
and keep their order by rarity; the rarest of them is thus among the ``bound + 1`` rarest of either word.
Only these lists are merged: words meet on (gram, end, distance from that end, length), which needs no
counting of common grams, and each pair met is verified by its edit distance. Words have ``LONGEST`` signs
or more, so some gram is always unaffected and no word needs another way.

Of words over ``2 * REACH`` signs only the grams that begin within ``REACH`` places of either end are taken;
one of them may leave that reach by the edit, so their bound is one higher.

Lists are joined, never collected: a list of grams below the longest holds at most ``frequent`` words. Gram
counts come back to their places by ``lookup_join``, which spreads the most frequent grams. Chains of forms
grow at least by ``ratio`` in count with each step, so they are short; they are followed by doubling.

Edge cases: a null text has no words; a null doc_id counts as no signs before the colon; repeated rows
count each; an empty table gives no rows; among equally frequent forms the smallest in code-point order is
taken. Texts are read whole; of a very long one a task holds all its words at once, about ten times its size.
Other columns of the documents are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.lookup import BROADCAST_KEYS, lookup_join
from lagwise.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LONGEST = 2, 6
REACH = 32
WORD = ["w1", "w2"]


def with_slips(run: Column, doc_id: Column, one_in: int) -> Column:
    """``run`` without one of its code points where the checksum of (doc_id, run) is divisible by ``one_in``."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    checksum = F.crc32(name.cast("binary"))
    at = (checksum % F.char_length(run)).cast("int")
    return F.when(
        checksum % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    ).otherwise(run)


def word_counts(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, one_in: int | None = 199, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(word, n) of the words of ``min_chars`` code points and ``min_count`` occurrences or more.

    ``one_in`` says how rarely the checksum rule deletes a sign from a word; None leaves words as they are.
    """
    lowered = F.translate(F.col(text).cast("string"), UPPER, UPPER.lower())
    runs = docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run")
    ).where(F.char_length("run") >= min_chars)
    word = F.col("run") if one_in is None else with_slips(F.col("run"), F.col("doc_id"), one_in)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars))


def gram_places(words: DataFrame) -> DataFrame:
    """(word hash, place, gram length, gram, whether it can grow) of every gram of every marked word."""
    size = F.char_length("marked")
    last = size - SHORTEST
    places = F.when(size <= 2 * REACH, F.sequence(F.lit(0), last)).otherwise(
        F.concat(F.sequence(F.lit(0), F.lit(REACH - 1)), F.sequence(last - REACH + 1, last))
    )
    rows = words.select(*WORD, F.concat(F.lit("^"), "word", F.lit("$")).alias("marked"))
    rows = rows.select(*WORD, "marked", F.explode(places).alias("place"))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), size - F.col("place")))
    rows = rows.select(*WORD, "marked", "place", F.explode(lengths).alias("length"))
    return rows.select(
        *WORD, "place", "length", F.substring("marked", F.col("place") + 1, F.col("length")).alias("gram"),
        ((F.col("length") < LONGEST) & (F.col("place") + F.col("length") < size)).alias("grows"),
    )


def decompose(words: DataFrame, frequent: int = 100) -> DataFrame:
    """(word hash, grams): a word's variable-length grams (n, gram, place, length), rarest first."""
    places = gram_places(words)
    counts = materialize(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    small = counts.count() <= BROADCAST_KEYS // 2
    counted = lookup_join(places, counts.select("gram", F.col("n").alias("weight"), "n"), ["gram"], "w1", "weight", small)
    stops = counted.where((F.col("n") <= frequent) | ~F.col("grows"))
    shortest = stops.groupBy(*WORD, "place").agg(F.min(F.struct("length", "n", "gram")).alias("g"))
    one = F.struct(F.col("g.n").alias("n"), F.col("g.gram").alias("gram"), "place", F.col("g.length").alias("length"))
    return shortest.groupBy(*WORD).agg(F.array_sort(F.collect_list(one)).alias("grams"))


def affected_bound(grams: Column, size: Column) -> Column:
    """The most grams of a word of ``size`` marked signs that one edit can change."""
    covering = F.transform(
        grams,
        lambda x: F.size(F.filter(grams, lambda y: (y["place"] <= x["place"]) & (x["place"] < y["place"] + y["length"]))),
    )
    return F.array_max(covering) + (size > 2 * REACH - 2).cast("int")


def near_pairs(words: DataFrame, frequent: int = 100) -> DataFrame:
    """(word, n, other, other_n), word before other in no particular order: all pairs one edit apart, once each."""
    hashed = words.select("word", "n", F.xxhash64(F.lit(21), "word").alias("w1"), F.xxhash64(F.lit(22), "word").alias("w2"))
    size = F.char_length("word") + 2
    grams = decompose(hashed, frequent).join(hashed, WORD)
    # stored, because both sides of the join below read it
    needed = grams.select(
        "word", "n", size.alias("size"), F.explode(F.slice("grams", F.lit(1), affected_bound(F.col("grams"), size) + 1)).alias("g")
    )
    ends = F.array(
        F.struct(F.lit(0).alias("end"), F.col("g.place").alias("far")),
        F.struct(F.lit(1).alias("end"), (F.col("size") - F.col("g.place") - F.col("g.length")).alias("far")),
    )
    lists = materialize(
        needed.select("word", "n", "size", F.col("g.gram").alias("gram"), F.inline(ends)), "gram-lists"
    )
    probe = lists.select(
        "gram", "end", "far", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("other_size"), "word", "n", "size"
    )
    index = lists.withColumnsRenamed({"word": "other", "n": "other_n", "size": "other_size"})
    met = probe.join(index, ["gram", "end", "far", "other_size"]).where(
        ((F.col("size") < F.col("other_size")) | (F.col("word") < F.col("other")))
        & (F.levenshtein("word", "other", 1) == 1)
    )
    return met.select("word", "n", "other", "other_n").distinct()


def variants(words: DataFrame, ratio: int = 5, frequent: int = 100) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a table (word, n) of distinct words.

    ``form`` is the most frequent near word if it occurs ``ratio`` times as often or more, ``root`` the
    end of the chain of forms.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words, frequent), "near-words")
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.unionByName(turned).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("root").alias("next"), F.col("word").alias("root"))
        jumped = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        roots = jumped.select("word", "root")
        if jumped.where(F.col("next").isNotNull()).isEmpty():
            break
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
