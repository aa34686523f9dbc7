"""Out-of-fold text scores: TF-IDF, logistic regression and the two fitting schemes.

Driver loops run over folds only; every count, join, fit and prediction is distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.scalars import descending_fold, even_fold, uniform_from_id
from lagwise.functions.text import letter_tokens, ngrams, rich_tokens
from lagwise.operators.evaluate import auc_by
from lagwise.operators.lookup import lookup_join
from lagwise.operators.tfidf import (
    document_frequency,
    smooth_idf,
    stored_tfidf_weights,
    sublinear_tf,
    term_counts,
    term_index,
)
from lagwise.plans.learners import FEATURES, ITERATIONS, stored_vector_parts, text_logistic
from lagwise.session import in_part, materialize, part_count, remove, replace_stored, store_parts


@dataclass(frozen=True)
class TextField:
    """How one text column is vectorised and fitted."""

    column: str
    largest_ngram: int
    min_df: int
    alpha: float


# --- fixed values: n-gram size, document floor and penalty per text field ----------------
FIRST_SCHEME = (
    TextField("title", 2, 2, 5e-6),
    TextField("short_description", 2, 2, 5e-6),
    TextField("need_statement", 2, 2, 5e-6),
    TextField("essay", 2, 2, 5e-6),
)
SECOND_SCHEME = (
    TextField("title", 3, 10, 5e-5),
    TextField("short_description", 2, 10, 1e-5),
    TextField("need_statement", 2, 10, 5e-5),
    TextField("essay", 4, 2, 4e-6),
)
# ----------------------------------------------------------------------------------------


#: Number of a row in its table.
ROW = "_row"
#: Places of a vector are 32-bit integers.
LARGEST_VOCABULARY = 2**31 - 1


def vectors(docs: DataFrame, doc: str, weights: DataFrame, size: int, name: str = FEATURES) -> DataFrame:
    """Add the sparse vector of (term_id, weight) rows to every document, written once.

    Documents without a known term get the zero vector. A vocabulary that does not fit the places of a vector is refused; raise the document floor then.
    """
    return _vectors(docs, doc, weights, size, name, 1)[0]


def _vectors(docs: DataFrame, doc: str, weights: DataFrame, size: int, name: str, parts: int) -> tuple[DataFrame, str]:
    if size > LARGEST_VOCABULARY:
        raise ValueError(f"{size} terms; a vector holds {LARGEST_VOCABULARY} at most")

    def joined(k: int) -> DataFrame:
        packed = weights.filter(in_part(doc, k, parts)).groupBy(doc).agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("term_id").cast("int").alias("_i"), F.col("weight").alias("_v")))
            ).alias("_terms")
        )
        return docs.filter(in_part(doc, k, parts)).join(packed, doc, "left").select(
            *docs.columns,
            F.lit(max(size, 1)).alias("size"),
            F.coalesce(F.col("_terms._i"), F.array().cast("array<int>")).alias("indices"),
            F.coalesce(F.col("_terms._v"), F.array().cast("array<double>")).alias("values"),
        )

    return stored_vector_parts(map(joined, range(parts)), name)


def score_fixed_vocabulary(
    docs: DataFrame,
    doc: str,
    field: TextField,
    y: str,
    trained: Column,
    folds: int = 10,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """(doc, pred_partial, pred): vocabulary from all documents, weights from trained rows.

    ``pred`` comes from one fit on all trained rows; ``pred_partial`` scores each trained row
    with the fit that left its fold out and is NULL elsewhere. Folds depend on the id alone.
    """
    spark = docs.sparkSession
    base = materialize(
        docs.select(
            doc,
            F.col(y).cast("double").alias("_y"),
            F.coalesce(trained, F.lit(False)).alias("_trained"),
            even_fold(uniform_from_id(F.col(doc), "text"), folds).alias("_fold"),
            F.monotonically_increasing_id().alias(ROW),
        ),
        "text-rows",
    )
    tokens = ngrams(rich_tokens(F.col(field.column)), field.largest_ngram)
    counts, stored_counts = replace_stored(term_counts(docs, doc, field.column, tokens), "terms")
    vocabulary, stored_terms = replace_stored(term_index(document_frequency(counts, field.min_df)), "vocabulary")
    weights, stored_weights = stored_tfidf_weights(counts, doc, vocabulary, F.lit(base.count()), named=False)
    parts, size = part_count(counts.count()), vocabulary.count()
    remove(spark, stored_counts)
    remove(spark, stored_terms)
    table, stored_table = _vectors(base.select(doc, ROW), doc, weights, size, FEATURES, parts)
    remove(spark, stored_weights)

    trained_rows = F.col("_trained")
    members = {"full": trained_rows} | {f"fold{k}": trained_rows & (F.col("_fold") != k) for k in range(folds)}
    models = text_logistic("_y", field.alpha, iterations).fit(base, table, ROW, FEATURES, members, parts)
    remove(spark, stored_table)
    left_out = {f"fold{k}": trained_rows & (F.col("_fold") == k) for k in range(folds)}
    scored = models.scored(base, {"full": F.lit(True)}, "full", [doc], "pred")
    partial = models.scored(base, left_out, "full", [doc], "pred_partial")
    result = materialize(scored.join(partial, doc, "left").select(doc, "pred_partial", "pred"), "text-scores")
    remove(spark, models.blocks)
    return result


def score_refitted_vocabulary(
    docs: DataFrame,
    doc: str,
    field: TextField,
    y: str,
    split: str,
    name: str,
    folds: int = 10,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """(doc, score): vocabulary and weights refitted for every scope.

    Train rows are scored by the fit without their fold, validation rows by the fit on train,
    test rows by the fit on train and validation. ``split`` holds train, validation or test.
    Document frequencies of all scopes come from one aggregation. All scopes read one stored table
    of sublinear counts under one term index: a scope is a vector of weights per term, which scales
    the counts inside its fit (see ``scope_scale``).
    """
    fold = F.when(
        F.col(split) == "train",
        descending_fold(uniform_from_id(F.col(doc), "refit"), folds),
    )
    spark = docs.sparkSession
    base = materialize(
        docs.select(
            doc, F.col(y).cast("double").alias("_y"), F.col(split).alias("_split"), fold.alias("_fold"),
            F.monotonically_increasing_id().alias(ROW),
        ),
        "text-rows",
    )
    tokens = ngrams(letter_tokens(F.col(field.column)), field.largest_ngram)
    marked = docs.withColumns({"_split": F.col(split), "_fold": fold})
    counts, stored_counts = replace_stored(
        term_counts(marked, doc, field.column, tokens, keep=["_split", "_fold"]), "terms"
    )

    is_train = F.col("_split") == "train"
    scopes: dict[str, Column] = {
        f"fold{i}": is_train & (F.col("_fold") != i) for i in range(1, folds + 1)
    }
    scopes["validation"] = is_train
    scopes["test"] = F.col("_split").isin("train", "validation")
    parts = part_count(counts.count())
    floor = field.min_df

    def frequency_part(k: int) -> DataFrame:
        found = counts.filter(in_part("term", k, parts)).groupBy("term").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count(F.when(scope, 1)).alias(f"df_{s}") for s, scope in scopes.items()],
        )
        # a scope counts rows of train and validation at most: a term rarer than the floor there weighs 0 in all of them
        return found.filter((F.col("_rows") >= floor) & (F.col("df_test") >= floor))

    frequencies, stored_frequencies = store_parts(map(frequency_part, range(parts)), "frequencies")
    frequencies, stored_terms = replace_stored(term_index(frequencies), "vocabulary", stored_frequencies)
    size = frequencies.count()
    sizes = base.agg(*[F.count(F.when(scope, 1)).alias(s) for s, scope in scopes.items()]).first()
    terms = frequencies.select("term", "term_id", "_rows")

    def weight_part(k: int) -> DataFrame:
        mine = in_part("term", k, parts)
        known = lookup_join(counts.filter(mine), terms.filter(mine), ["term"], doc, "_rows")
        return known.filter(F.col("term_id").isNotNull()).select(
            doc, "term_id", sublinear_tf(F.col("tf")).alias("weight")
        )

    weights, stored_weights = store_parts(map(weight_part, range(parts)), "weights")
    remove(spark, stored_counts)
    table, stored_table = _vectors(base.select(doc, ROW), doc, weights, size, "_counts", parts)
    remove(spark, stored_weights)

    scales = frequencies.select(
        "term_id", *[scope_idf(f"df_{s}", sizes[s], field.min_df).alias(s) for s in scopes]
    )
    models = text_logistic("_y", field.alpha, iterations).fit(base, table, ROW, "_counts", scopes, parts, scales)
    remove(spark, stored_table)
    targets = {s: F.col("_fold") == int(s[4:]) if s.startswith("fold") else F.col("_split") == s for s in scopes}
    remove(spark, stored_terms)
    result = materialize(models.scored(base, targets, "test", [doc], name), "text-scores")
    remove(spark, models.blocks)
    return result


def scope_idf(df: str, documents: int, floor: int) -> Column:
    """Smooth idf; 0 for a term found in fewer than ``floor`` documents of the scope."""
    return F.when(F.col(df) >= floor, smooth_idf(F.lit(documents), F.col(df))).otherwise(0.0)


def scope_scale(frequencies: DataFrame, df: str, documents: int, floor: int, size: int) -> np.ndarray:
    """Smooth idf per ``term_id``; 0 for a term found in fewer than ``floor`` documents of the scope.

    The driver holds it as it holds the weights of the fit: 8 bytes per term, twice while the rows
    arrive, for one scope at a time.
    """
    rows = frequencies.select("term_id", scope_idf(df, documents, floor).alias("idf")).toArrow()
    scale = np.zeros(max(size, 1))
    scale[rows["term_id"].to_numpy()] = rows["idf"].to_numpy()
    return scale


def scaled(table: DataFrame, scale: np.ndarray) -> DataFrame:
    """``table`` with ``_counts`` scaled per term and brought to unit length, all in MLlib."""
    product = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_counts", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=FEATURES)
    return unit.transform(product.transform(table)).drop("_counts", "_scaled")


def score_columns(
    docs: DataFrame, doc: str, y: str, fields: Sequence[TextField], trained: Column,
    folds: int = 10, iterations: int = ITERATIONS,
) -> DataFrame:
    """One row per document with <field>_<y>_pred_partial and <field>_<y>_pred per field."""
    result = docs.select(doc)
    for field in fields:
        scored = score_fixed_vocabulary(docs, doc, field, y, trained, folds, iterations).select(
            doc,
            F.col("pred_partial").alias(f"{field.column}_{y}_pred_partial"),
            F.col("pred").alias(f"{field.column}_{y}_pred"),
        )
        result = result.join(scored, doc, "left")
    return result


def refitted_columns(
    docs: DataFrame, doc: str, y: str, split: str, fields: Sequence[TextField], folds: int = 10,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """One row per document with <field>_tfidf for every field, vocabulary refitted per scope."""
    result = docs.select(doc)
    for field in fields:
        name = f"{field.column}_tfidf"
        scored = score_refitted_vocabulary(docs, doc, field, y, split, name, folds, iterations)
        result = result.join(scored.select(doc, name), doc, "left")
    return result


def fold_auc(scored: DataFrame, score: str, y: str, fold: Column, folds: int) -> DataFrame:
    """(fold, part, positives, negatives, auc): AUC on each fold (``test``) and on all rows outside it (``train``)."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(folds - 1)),
        lambda n: F.struct(n.alias("fold"), F.when(F.col("_fold") == n, "test").otherwise("train").alias("part")),
    )
    marked = scored.select(fold.alias("_fold"), score, y).select(score, y, F.inline(parts))
    return auc_by(marked, ["fold", "part"], score, y)
