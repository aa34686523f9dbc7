"""Estimators of both plans, all trained and applied by MLlib."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.plans.text_fit import TextLogistic
from lagwise.session import store_parts

FEATURES = "features"
#: Cuts tried for a numeric input; categories with more levels raise it to their number.
BINS = 64
#: Ends a logistic fit that does not reach its tolerance.
ITERATIONS = 1000


def impute_flags(
    df: DataFrame, constants: dict[str, float], suffix: str = "_imp", flag: str = "_missing"
) -> DataFrame:
    """Add ``<column>_imp`` (NULL and NaN replaced) and the 0/1 indicator ``<column>_missing``.

    MLlib models reject missing values; the indicator keeps the information.
    """
    added: dict[str, Column] = {}
    for name, constant in constants.items():
        value = F.col(name).cast("double")
        missing = value.isNull() | F.isnan(value)
        added[f"{name}{suffix}"] = F.when(missing, F.lit(float(constant))).otherwise(value)
        added[f"{name}{flag}"] = F.coalesce(missing, F.lit(True)).cast("int")
    return df.withColumns(added)


def by_kind(features: Sequence[str], categorical: set[str]) -> tuple[list[str], list[str]]:
    """Split a feature list into (numeric, categorical), each in its given order."""
    return (
        [f for f in features if f not in categorical],
        [f for f in features if f in categorical],
    )


def complete(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keep: Sequence[str],
    flagged: Sequence[str] = (),
) -> tuple[DataFrame, list[str], list[str]]:
    """Narrow to model inputs without missing values; returns (df, numeric, categorical).

    One input per feature; only those in ``flagged`` also get a column that says where they
    were missing. A forest that tries two inputs per split must not meet constant flags.
    """
    filled = impute_flags(df, {c: -1.0 for c in numeric})
    cats = {f"{c}_cat": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical}
    names = [f"{c}_imp" for c in numeric] + [f"{c}_missing" for c in flagged]
    out = filled.withColumns(cats) if cats else filled
    return out.select(*keep, *names, *cats), names, list(cats)


def tree_inputs(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages that index categories and assemble the feature vector for tree models."""
    stages = []
    indexed = [f"{c}_ix" for c in categorical]
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=list(categorical),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
    stages.append(VectorAssembler(inputCols=[*numeric, *indexed], outputCol=FEATURES))
    return stages


def design_matrix(
    train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """One numeric column per design-matrix term, and the list of those columns.

    Levels are the distinct values of the training rows in alphabetical order, first level
    dropped, plus an intercept. They are learnt once and reused for every row; an unseen level
    becomes all zeros. The matrix has a column per level, so its columns must be categories of
    few levels (states, types, prefixes); free identifiers belong into a target encoding.
    """
    terms: dict[str, Column] = {"intercept": F.lit(1.0)}
    for name in numeric:
        terms[name] = F.col(name).cast("double")
    levels = train.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in categorical]).first()
    for name in categorical:
        for level in levels[name][1:]:
            terms[f"{name}{level}"] = F.coalesce(F.col(name) == level, F.lit(False)).cast("double")
    return df.withColumns({f"x_{i}": term for i, term in enumerate(terms.values())}), list(terms)


def stored_vectors(df: DataFrame, name: str) -> DataFrame:
    """``df`` with (size, indices, values) as one sparse vector column, written once.

    The table is stored with the vector's storage struct and read back as a vector column, so no
    Python runs per row.
    """
    return stored_vector_parts([df], name)[0]


def stored_vector_parts(parts: Iterable[DataFrame], name: str) -> tuple[DataFrame, str]:
    """As ``stored_vectors`` for a table in parts, which are written one after another; also gives the path."""
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.col("size").cast("int").alias("size"),
        F.col("indices").cast("array<int>").alias("indices"), F.col("values").alias("values"),
    )
    plain = lambda df: df.drop("size", "indices", "values")
    first: list[DataFrame] = []

    def packed(df: DataFrame) -> DataFrame:
        first[:] = first or [df]
        return df.select(*plain(df).columns, vector.alias(name))

    _, path = store_parts(map(packed, parts), "vectors")
    schema = T.StructType([*plain(first[0]).schema.fields, T.StructField(name, VectorUDT())])
    return first[0].sparkSession.read.schema(schema).parquet(path), path


def fit(estimator, stages: list, train: DataFrame) -> PipelineModel:
    """Fit stages and estimator; a tree gets at least as many bins as a category has levels."""
    named = [c for s in stages if isinstance(s, StringIndexer) for c in s.getInputCols()]
    if named and estimator.hasParam("maxBins"):
        levels = max(train.agg(*[F.count_distinct(c) for c in named]).first()) + 1
        if levels > estimator.getMaxBins():
            estimator = estimator.copy({estimator.maxBins: levels})
    return Pipeline(stages=[*stages, estimator]).fit(train)


def boosted_trees(
    label: str, trees: int, splits: int, rate: float, bag: float, min_rows: int, seed: int = 1
) -> GBTClassifier:
    """``splits`` counts split nodes per tree; the depth is the smallest that holds as many."""
    depth = max(1, splits.bit_length())
    return GBTClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=bag,
        minInstancesPerNode=min_rows,
        maxBins=BINS,
        seed=seed,
    )


def random_forest(
    label: str, trees: int, per_split: int, min_rows: int, depth: int, seed: int = 1
) -> RandomForestClassifier:
    """Forest on samples drawn without replacement; the share 0.632 is the usual sample size."""
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        numTrees=trees,
        featureSubsetStrategy=str(per_split),
        bootstrap=False,
        subsamplingRate=0.632,
        minInstancesPerNode=min_rows,
        maxDepth=depth,
        maxBins=BINS,
        seed=seed,
    )


def coarse_forest(
    label: str, trees: int, per_split: int, min_rows: int, depth: int, bins: int = 16,
    seed: int = 1,
) -> RandomForestRegressor:
    """Regression forest on 0/1 over all rows with few candidate cuts per feature.

    Stands in for extremely randomised trees, which MLlib lacks: same role in the blend, but
    the cuts are coarse rather than random, so single scores differ.
    """
    return RandomForestRegressor(
        labelCol=label,
        featuresCol=FEATURES,
        numTrees=trees,
        featureSubsetStrategy=str(per_split),
        bootstrap=False,
        subsamplingRate=1.0,
        minInstancesPerNode=min_rows,
        maxDepth=depth,
        maxBins=bins,
        seed=seed,
    )


def ridge_cv(label: str, penalties: Sequence[float], folds: int, seed: int = 1) -> CrossValidator:
    """Ridge logistic regression with the penalty of the smallest cross-validated log loss."""
    logistic = LogisticRegression(
        labelCol=label, featuresCol=FEATURES, elasticNetParam=0.0, maxIter=ITERATIONS
    )
    grid = ParamGridBuilder().addGrid(logistic.regParam, list(penalties)).build()
    return CrossValidator(
        estimator=logistic,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss"),
        numFolds=folds,
        parallelism=2,
        seed=seed,
    )


def largest_penalty(train: DataFrame, numeric: Sequence[str], label: str) -> float:
    """Start of the ridge penalty path: the largest |covariance| of a standardised input with
    the label, divided by 0.001, the smallest mixing share the path is defined for.

    One aggregation, one row.
    """
    sizes = train.agg(
        *[
            F.abs(
                F.try_divide(F.covar_pop(c, F.col(label).cast("double")), F.stddev_pop(c))
            ).alias(c)
            for c in numeric
        ]
    ).first()
    known = [size for size in sizes if size is not None]
    return max(known, default=0.001) / 0.001


def penalty_path(largest: float, smallest_ratio: float = 0.005, steps: int = 6) -> list[float]:
    """Geometric path from ``largest`` down to ``largest * smallest_ratio``."""
    return [largest * smallest_ratio ** (i / (steps - 1)) for i in range(steps)]


def text_logistic(label: str, alpha: float, iterations: int = ITERATIONS) -> TextLogistic:
    """L2 logistic regression on unscaled TF-IDF vectors; mean loss + alpha / 2 * |w|^2.

    It stops at the tolerance; ``iterations`` only ends a fit that does not converge. No vector over the
    vocabulary is held anywhere (see ``text_fit``).
    """
    return TextLogistic(label, alpha, iterations)


def probability(model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Score rows with a classifier: (kept columns, P(label = 1))."""
    return model.transform(df).select(
        *keep, vector_to_array("probability").getItem(1).alias(name)
    )


def regression(model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Score rows with a regressor: (kept columns, prediction)."""
    return model.transform(df).select(*keep, F.col("prediction").alias(name))
