"""Registered queries of the dealt operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import (
    decontaminate, histogram_shards, language, licenses, line_runs, near_dedup, packed_ids, page_text, phrases, quality, raking,
    spelling, syncmers,
)
from lagwise.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    r"""
    WITH item AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE text IS NOT NULL
    ), win AS (
        SELECT DISTINCT item_id, len(part) AS n, array_to_string(part, ' ') AS part FROM (
            SELECT item_id, unnest([w[i : i + least(10, len(w)) - 1] FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS part
            FROM item WHERE len(w) > 0)
    ), doc AS (
        SELECT doc_id, row_number() OVER () AS r,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents
    ), place AS (
        SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS part
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
    ), occurs AS (
        SELECT r, i, win.n, item_id FROM place JOIN win ON place.n = win.n AND place.part = win.part
    ), hit AS (
        SELECT r, count(DISTINCT word_no) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word_no FROM occurs) GROUP BY r
    ), named AS (
        SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM occurs) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """
)
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    r"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
        FROM documents
    ), sh AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)
    ), sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), link AS (
        SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
        WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM doc
        UNION
        SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
    ), least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM doc JOIN least_id USING (doc_id) LEFT JOIN sized USING (doc_id)
    """
)
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have similarity 0.75 or more."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query()
def op2_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of near equal bytes, in the order of (text hash, doc_id)."""
    placed = histogram_shards.shard_by_bytes(table(spark, folder, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def fold(divisor: int) -> Column:
    """Remainder of the crc32 of the doc_id as text; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of label 1 of every document; learnt outside the held-out third."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, folder, "labels"), fold(3) != 1)
    return quality.scored(documents, model).select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; prototypes are learnt outside the held-out quarter."""
    documents = table(spark, folder, "documents")
    prototypes = language.learn_where(documents.select("doc_id", "text", "lang"), F.coalesce(fold(4) != 2, F.lit(False)))
    return language.predicted(documents.select("doc_id", "text"), prototypes).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query(raking.sql())
def op5_raking(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's calibrated probability and draw after raking to tempered targets."""
    found = raking.mixed(table(spark, folder, "documents"))
    none = F.lit(raking.NONE)
    return found.select(
        "doc_id",
        F.coalesce("source", none).alias("source"),
        F.coalesce("lang", none).alias("lang"),
        "topic",
        F.round("probability", 9).alias("probability"),
        "kept",
    )


@query()
def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return syncmers.compare_with_edits(table(spark, folder, "documents"))


@query()
def op4_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, packed to files in the shared folder and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    target = fresh_path(spark, "packed-ids")
    packed_ids.write_packed(table(spark, folder, "documents"), target, path)
    return packed_ids.read_documents(spark, target, with_ids=False)


@query()
def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extracted(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@query(licenses.sql())
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("license_sentences").cast("long").alias("n_known"),
        F.array_join(F.col("license_sentences")["id"], ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        (F.size("licenses") > 0).alias("licensed"),
    )


@query(
    r"""
    WITH line AS (
        SELECT r, doc_id, i, l[i] AS line,
               translate(trim(l[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i
              FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
    ), common AS (SELECT k FROM line WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
    FROM line LEFT JOIN common USING (k) GROUP BY r
    """
)
def op12_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    kept = line_runs.without_common_lines(table(spark, folder, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(
    r"""
    WITH RECURSIVE steps AS (
        SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
        UNION ALL
        SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
    ), tbl AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
    run AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents)
        GROUP BY ALL HAVING length(run) >= 6
    ), hexed AS (
        SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run
    ), sums AS (
        SELECT run, n, xor(list_reduce(
            [(strpos('0123456789ABCDEF', x[2 * j - 1]) * 16 + strpos('0123456789ABCDEF', x[2 * j]) - 17)::BIGINT FOR j IN range(1, length(x) // 2 + 1)],
            lambda crc, byte: xor(crc >> 8, t[1 + xor(crc & 255, byte)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
        FROM hexed, tbl
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
            FROM sums)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), cut AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT a.word AS w, b.word AS o, b.n AS o_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT w, o, o_n, count(*) OVER (PARTITION BY w) AS c, row_number() OVER (PARTITION BY w ORDER BY o_n DESC, encode(o)) AS place FROM near
    ), form AS (
        SELECT word, n, coalesce(c, 0) AS n_near, CASE WHEN o_n >= 5 * n THEN o END AS form, CASE WHEN o_n >= 5 * n THEN o_n END AS form_n
        FROM words LEFT JOIN best ON w = word AND place = 1
    ), chain AS (
        SELECT word, word AS at, form AS next FROM form
        UNION ALL SELECT chain.word, form.word, form.form FROM chain JOIN form ON chain.next = form.word
    )
    SELECT form.word, form.form, chain.at AS root, n, n_near, form_n
    FROM form JOIN chain ON chain.word = form.word AND chain.next IS NULL
    """
)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, more frequent form and root."""
    words = spelling.word_counts(table(spark, folder, "documents"), min_chars=6, min_count=5, one_in=199)
    return spelling.variants(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


@query(
    r"""
    WITH piece AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p,
               regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09]+') AS w
        FROM (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
    ), f AS (
        SELECT lang, k, phrase, count(*) AS n FROM (
            SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
            FROM piece, range(1, 5) t(k))
        GROUP BY ALL
    ), many AS (SELECT * FROM f WHERE n >= 30),
    cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM many WHERE k > 1),
    cut AS (
        SELECT cand.lang, cand.phrase, a, c, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score
        FROM (SELECT *, unnest(range(1, k)) AS c FROM cand) cand
        JOIN many x ON x.lang = cand.lang AND x.phrase = array_to_string(w[1 : c], ' ')
        JOIN many y ON y.lang = cand.lang AND y.phrase = array_to_string(w[c + 1 : cand.k], ' ')
    ), low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM cut),
    part AS (
        SELECT lang, a, array_to_string(w[i : i + z - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - z + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS z FROM cand))
    ), ranked AS (
        SELECT lang, phrase, a, l, r, score,
               row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM low WHERE place = 1 AND NOT EXISTS (
            SELECT 1 FROM part WHERE part.lang = low.lang AND part.phrase = low.phrase AND 100::HUGEINT * part.a >= 80::HUGEINT * low.a)
    )
    SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score
    FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) t USING (lang) WHERE rank <= 2000
    """
)
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of two to four words of every language."""
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"), threshold=30, top=2000, percent=80)
