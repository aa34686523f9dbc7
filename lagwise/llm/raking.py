"""Mixing documents to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed into cells of (source, language, topic). The tokens of the cells are raked:
scaled in turn to the target share of every source, every language and every topic, ``rounds`` times
over. A cell's raked weight over its tokens is its factor; probabilities are the factors times one
level, at most 1, chosen so that the expected number of tokens is ``keep`` of all. A document stays
if a number drawn from a hash of its id lies below the probability of its cell.

Targets are given as shares by name or, by default, tempered from the data: the share of a value is
its tokens to the power of an exponent below 1, which lifts rare values and holds back common ones.

Only cells are raked. Sums are combined before each shuffle and the cells are joined to documents by
Spark's own choice of join, so a hot source is summed first and split in the join.

Edge cases: null values are a value of their own (``(none)``); a document weighs its words and one
more for its end, so an empty or null text weighs 1; rows of the same doc_id share their draw; values
that a given target does not name have target 0 and go. No documents give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.columns import apart
from lagwise.session import materialize

NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the default targets.
EXPONENTS = {"source": 0.7, "lang": 0.8, "topic": 0.8}
_TOKENS, _WEIGHT = "_tokens", "_weight"
_CELL = {name: f"_cell_{name}" for name in DIMENSIONS}


def topic_of(text: Column) -> Column:
    """A coarse kind of text: licence wording, figures, several lines, or a note."""
    return (
        F.when(text.rlike("(?i)licen|copyright"), "legal")
        .when(text.rlike("[0-9]"), "figures")
        .when(text.contains("\n"), "article")
        .otherwise("note")
    )


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _celled(documents: DataFrame, text: str, topic: Column | None) -> DataFrame:
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(content) if topic is None else topic}
    return documents.withColumns({_CELL[d]: F.coalesce(v.cast("string"), F.lit(NONE)) for d, v in values.items()})


def _targets(cells: DataFrame, name: str, given: dict[str, float] | None) -> DataFrame:
    """Share of every value of a dimension; shares sum to 1 over the values there are."""
    totals = cells.groupBy(_CELL[name]).agg(F.sum(_TOKENS).alias("tokens"))
    if given is None:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(EXPONENTS[name]))
    else:
        items = [x for pair in given.items() for x in (F.lit(pair[0]), F.lit(float(pair[1])))]
        raw = F.coalesce(F.element_at(F.create_map(*items), F.col(_CELL[name])), F.lit(0.0))
    raised = totals.select(_CELL[name], raw.alias("raw"))
    total = raised.agg(F.sum("raw")).first()[0] or 1.0
    return raised.select(_CELL[name], (F.col("raw") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Cells with ``_weight``: tokens scaled to the targets of each dimension in turn."""
    total = cells.agg(F.sum(_TOKENS)).first()[0] or 0
    now = cells.withColumn(_WEIGHT, F.col(_TOKENS).cast("double"))
    for _ in range(rounds):
        for name in DIMENSIONS:
            held = now.groupBy(_CELL[name]).agg(F.sum(_WEIGHT).alias("held"))
            factor = held.join(targets[name], _CELL[name]).select(
                _CELL[name], F.when(F.col("held") > 0, F.lit(float(total)) * F.col("target") / F.col("held")).otherwise(0.0).alias("factor")
            )
            now = now.join(factor, _CELL[name]).withColumn(_WEIGHT, F.col(_WEIGHT) * F.col("factor")).drop("factor")
            now = materialize(now, "raked")  # each step reads its cells twice: keep plans from growing
    return now


def _level(cells: DataFrame, keep: float, rounds: int = 8) -> float:
    """Level at which the capped probabilities keep the wanted share of tokens."""
    factor = F.col(_WEIGHT) / F.col(_TOKENS)
    total = cells.agg(F.sum(_TOKENS)).first()[0] or 0
    level = keep
    for _ in range(rounds):
        capped = F.lit(level) * factor >= 1
        full, rest = cells.agg(
            F.coalesce(F.sum(F.when(capped, F.col(_TOKENS))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col(_WEIGHT))), F.lit(0.0))
        ).first()
        if rest <= 0:
            break
        level = (keep * total - full) / rest
    return level


def mixed(
    documents: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = 0.8,
    rounds: int = 6,
    seed: str = "mix",
    probability: str = "probability",
    kept: str = "kept",
    topic_name: str = "topic",
) -> DataFrame:
    """``documents`` with their topic, the probability of their cell and whether they stay."""
    documents, restore = apart(documents.drop(probability, kept, topic_name), _TOKENS, _WEIGHT, *_CELL.values())
    celled = _celled(documents, text, topic)
    tokens = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)) + 1
    cells = materialize(celled.groupBy(*_CELL.values()).agg(F.sum(tokens.cast("long")).alias(_TOKENS)), "cells")
    wanted = {name: materialize(_targets(cells, name, (targets or {}).get(name)), "targets") for name in DIMENSIONS}
    raked = rake(cells, wanted, rounds)
    level = _level(raked, keep)
    chances = materialize(
        raked.select(*_CELL.values(), F.least(F.lit(1.0), F.lit(level) * F.col(_WEIGHT) / F.col(_TOKENS)).alias(probability)), "chances"
    )
    joined = celled.join(chances, list(_CELL.values()))
    chosen = joined.select(
        *[F.col(f"`{c}`") for c in documents.columns],
        F.col(_CELL["topic"]).alias(topic_name),
        probability,
        (draw(F.col(doc_id), seed) < F.col(probability)).alias(kept),
    )
    return restore(chosen)


def sampled(documents: DataFrame, **settings) -> DataFrame:
    """The documents that stay, with their own columns."""
    flags = {"probability": "_probability", "kept": "_kept", "topic_name": "_topic"}
    documents, restore = apart(documents, *flags.values())
    return restore(mixed(documents, **settings, **flags).where("_kept").select(*[F.col(f"`{c}`") for c in documents.columns]))


def sql(rounds: int = 6, keep: float = 0.8, level_rounds: int = 8, seed: str = "mix", digits: int = 9) -> str:
    """The same with the default targets, for DuckDB."""
    parts = [
        r"""WITH doc AS (
            SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                   CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen|copyright') THEN 'legal'
                        WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures'
                        WHEN contains(coalesce(text, ''), chr(10)) THEN 'article' ELSE 'note' END AS topic,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens
            FROM documents
        ), w0 AS (
            SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS w
            FROM doc GROUP BY source, lang, topic)"""
    ]
    for name, exponent in (("source", 0.7), ("lang", 0.8), ("topic", 0.8)):
        parts.append(
            f"t_{name} AS (SELECT {name}, raw / sum(raw) OVER () AS target FROM "
            f"(SELECT {name}, pow(sum(tokens)::DOUBLE, {exponent}) AS raw FROM w0 GROUP BY {name}))"
        )
    step = 0
    for _ in range(rounds):
        for name in ("source", "lang", "topic"):
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * (sum(tokens) OVER ())::DOUBLE * target"
                f" / sum(w) OVER (PARTITION BY {name}) AS w FROM w{step} JOIN t_{name} USING ({name}))"
            )
            step += 1
    parts.append(f"l0 AS (SELECT {keep}::DOUBLE AS level)")
    for k in range(level_rounds):
        parts.append(
            f"l{k + 1} AS MATERIALIZED (SELECT ({keep} * sum(tokens) - coalesce(sum(CASE WHEN level * w / tokens >= 1 THEN tokens END), 0))"
            f" / sum(CASE WHEN level * w / tokens < 1 THEN w END) AS level FROM w{step}, l{k} GROUP BY level)"
        )
    parts.append(f"chance AS (SELECT source, lang, topic, least(1.0, level * w / tokens) AS p FROM w{step}, l{level_rounds})")
    return reduce(lambda a, b: f"{a}, {b}", parts) + (
        f" SELECT doc_id, source, lang, topic, round(p, {digits}) AS probability,"
        f" ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept"
        " FROM doc JOIN chance USING (source, lang, topic)"
    )
