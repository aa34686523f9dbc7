"""First scoring plan: entity and donor histories, text scores, stacked boosted trees."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions import dates, scalars, text
from lagwise.operators.assemble import (
    blank_as_other,
    conditional_rollup,
    donor_rollup,
    keep_first,
    star,
)
from lagwise.operators.calendar import trailing_rate
from lagwise.operators.levels import design_rows, level_codes
from lagwise.operators.lookback import entity_histories, entity_history
from lagwise.operators.splits import training_mask
from lagwise.plans import learners
from lagwise.plans.text_scores import FIRST_SCHEME, TextField, score_columns
from lagwise.session import materialize, settled
from lagwise.sources.tables import Tables, one_essay

# --- fixed values: entities, labels, codes, features, sizes ------------------------------
HISTORY_KEYS = [
    "teacher_acctid", "schoolid", "school_district", "school_city", "school_county",
    "school_zip", "school_state",
]
DONOR_KEYS = ["teacher_acctid", "schoolid"]
DONOR_GROUP = [
    "projectid", "date_posted", "teacher_acctid", "schoolid", "school_district", "school_city",
    "school_zip",
]
FLAG_LABELS = {
    "y": "is_exciting",
    "y2": "at_least_1_teacher_referred_donor",
    "y3": "great_chat",
    "y4": "fully_funded",
    "y5": "at_least_1_green_donation",
    "y6": "donation_from_thoughtful_donor",
    "y7": "three_or_more_non_teacher_referred_donors",
    "y8": "one_non_teacher_referred_donor_giving_100_plus",
}
COUNT_LABELS = {"y9": "teacher_referred_count", "y10": "non_teacher_referred_count"}
LABELS = [*FLAG_LABELS, *COUNT_LABELS]
DONOR_LABELS = ["y11", "y12", "y13"]
RESOURCE_TYPES = {
    "books": "Books", "supplies": "Supplies", "trips": "Trips", "other": "Other",
    "tech": "Technology", "visitors": "Visitors",
}
POVERTY_LEVELS = ["moderate poverty", "high poverty", "highest poverty"]
GRADE_LEVELS = ["Grades 3-5", "Grades 6-8", "Grades 9-12"]
CREDIBILITY_K = 10
RATE_CAP = (0.0, 0.25)
TREE_FEATURES = [
    "school_latitude", "school_longitude", "school_metro", "teacher_prefix",
    "teacher_teach_for_america", "teacher_ny_teaching_fellow",
    "total_price_excluding_optional_support", "students_reached_imp",
    "eligible_double_your_impact_match", "eligible_almost_home_match", "poverty_level",
    "primary_focus_area", "resource_type", "essay_length", "title_length", "title_y_pp",
    "essay_y_pp", "agg_item_amount_total", "agg_cnt", "books_cnt", "books_item_amount_total",
    "supplies_item_amount_total", "other_item_amount_total", "tech_item_amount_total",
    "weekday", "teacher_acctid_days", "schoolid_days", "teacher_acctid_cnt", "schoolid_cnt",
    "teacher_acctid_y_prev_rate_cred", "schoolid_y_prev_rate_cred_cap",
    "school_district_y_prev_rate", "school_county_y_prev_rate", "schoolid_y2_prev_rate",
    "teacher_acctid_y2_prev_rate", "schoolid_y3_prev_rate", "teacher_acctid_y3_prev_rate",
    "school_district_y3_prev_rate", "schoolid_y4_prev_rate", "schoolid_y5_prev_rate",
    "teacher_acctid_y5_prev_rate", "price_per_student_imp", "schoolid_y11_prev",
    "teacher_acctid_y11_prev", "schoolid_y12_prev", "teacher_acctid_y12_prev",
    "schoolid_y13_prev", "teacher_acctid_y13_prev",
]
MATRIX_FEATURES = [
    "school_metro", "teacher_prefix", "teacher_teach_for_america", "students_reached_imp",
    "price_per_student_imp", "teacher_ny_teaching_fellow",
    "total_price_excluding_optional_support", "eligible_double_your_impact_match",
    "eligible_almost_home_match", "poverty_level", "primary_focus_area", "resource_type",
    "essay_length", "title_length", "title_y_pp", "essay_y_pp", "agg_item_amount_total",
    "agg_cnt", "books_cnt", "books_item_amount_total", "supplies_item_amount_total",
    "other_item_amount_total", "tech_item_amount_total", "weekday", "teacher_acctid_cnt",
    "schoolid_cnt", "teacher_acctid_y_prev_rate_cred", "schoolid_y_prev_rate_cred_cap",
    "school_district_y_prev_rate", "school_county_y_prev_rate", "schoolid_y2_prev_rate",
    "teacher_acctid_y2_prev_rate", "schoolid_y3_prev_rate", "teacher_acctid_y3_prev_rate",
    "school_district_y3_prev_rate", "schoolid_y4_prev_rate", "schoolid_y5_prev_rate",
    "teacher_acctid_y5_prev_rate", "schoolid_y11_prev", "teacher_acctid_y11_prev",
    "schoolid_y12_prev", "teacher_acctid_y12_prev", "schoolid_y13_prev",
    "teacher_acctid_y13_prev", "avg_biweekly_pred_v1",
]
CATEGORICAL = {
    "school_metro", "teacher_prefix", "teacher_teach_for_america",
    "teacher_ny_teaching_fellow", "eligible_double_your_impact_match",
    "eligible_almost_home_match", "poverty_level", "primary_focus_area", "resource_type",
    "weekday",
}
TRAILING_ROWS = {
    "avg_biweekly_pred_v1": 14, "avg_monthly_pred_v1": 30, "avg_bimonthly_pred_v1": 61,
}
STACKED = {
    "pred_v2": "avg_monthly_pred_v1", "pred_v4": "avg_biweekly_pred_v1",
    "pred_v5": "avg_bimonthly_pred_v1",
}
BLEND = {"pred_v1": 0.1, "pred_v2": 0.1, "pred_v4": 0.45, "pred_v5": 0.1, "pred_et_v4": 0.25}
TREES_FIRST, TREES_STACKED, TREES_FOREST = 650, 600, 2000
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FirstSettings:
    """Dates and sizes; the defaults are the original ones."""

    history_start: dt.date = dt.date(2010, 4, 1)
    text_validation: dt.date = dt.date(2013, 1, 1)
    train_start: dt.date = dt.date(2011, 1, 1)
    validation: dt.date = dt.date(2013, 9, 1)
    test: dt.date = dt.date(2014, 1, 1)
    trailing_start: dt.date = dt.date(2010, 9, 1)
    time_origin: dt.date = dt.date(2010, 12, 31)
    data_end: dt.date = dt.date(2014, 5, 12)
    discount_floor: float = 0.5
    discount_span: int = 131
    tree_share: float = 1.0
    min_rows: int = 750
    forest_min_rows: int = 50
    forest_depth: int = 30
    folds: int = 10
    text_fields: tuple[TextField, ...] = field(default=FIRST_SCHEME)
    text_iterations: int = learners.ITERATIONS

    def trees(self, full: int) -> int:
        return max(1, round(full * self.tree_share))


def labels() -> dict[str, Column]:
    """y..y10 with unknown outcomes as 0."""
    flags = {name: scalars.flag_or_zero(F.col(c)) for name, c in FLAG_LABELS.items()}
    return flags | {name: scalars.reaches(F.col(c)) for name, c in COUNT_LABELS.items()}


def history_cuts(s: FirstSettings) -> list[tuple[dt.date | None, str]]:
    return [(None, "none"), (s.history_start, "train"), (s.text_validation, "val"), (s.test, "test")]


def training_cuts(s: FirstSettings) -> list[tuple[dt.date | None, str]]:
    return [(None, "none"), (s.train_start, "train"), (s.validation, "val"), (s.test, "test")]


def history_base(tables: Tables, s: FirstSettings) -> DataFrame:
    """Narrow labelled rows all histories start from, written once and scanned per entity."""
    joined = tables.projects.join(tables.outcomes, "projectid", "left")
    return materialize(
        joined.filter(F.col("date_posted") >= F.lit(s.history_start)).select(
            "projectid", "date_posted", *HISTORY_KEYS, *[c.alias(n) for n, c in labels().items()]
        ),
        "history-base",
    )


def histories(base: DataFrame, s: FirstSettings) -> DataFrame:
    """The histories of all entities, one row per project of ``base``."""
    counted = F.col("date_posted") < F.lit(s.test)
    return entity_histories(base, HISTORY_KEYS, "date_posted", "projectid", LABELS, counted)


def donor_base(tables: Tables) -> DataFrame:
    return donor_rollup(
        tables.projects,
        tables.donations,
        "projectid",
        DONOR_GROUP,
        scalars.flag_or_zero(F.col("is_teacher_acct")),
        "donation_total",
    )


def donor_history(base: DataFrame, key: str) -> DataFrame:
    """Donation history of one entity, over all dates."""
    return entity_history(base, key, "date_posted", "projectid", DONOR_LABELS).select(
        "projectid", *[f"{key}_{y}_prev" for y in DONOR_LABELS]
    )


def donor_histories(base: DataFrame) -> dict[str, DataFrame]:
    """Donation history per entity, over all dates."""
    return {key: donor_history(base, key) for key in DONOR_KEYS}


def resource_totals(tables: Tables) -> DataFrame:
    return conditional_rollup(
        tables.resources,
        "projectid",
        blank_as_other("project_resource_type"),
        F.col("item_unit_price") * F.col("item_quantity"),
        RESOURCE_TYPES,
    )


def history_columns() -> list[str]:
    names = []
    for key in HISTORY_KEYS:
        names += [f"{key}_days", *[f"{key}_{y}_prev" for y in LABELS]]
        names += [f"{key}_cnt", f"{key}_cnt_train"]
    return names


def resource_columns() -> list[str]:
    prefixes = ["agg", *RESOURCE_TYPES]
    return [f"{p}_cnt" for p in prefixes] + [f"{p}_item_amount_total" for p in prefixes]


def assemble(tables: Tables, s: FirstSettings, text_scores: DataFrame | None = None) -> DataFrame:
    """One row per project: outcomes, all histories, text scores, donors and resources.

    Missing histories, referred counts and resource totals become 0; missing donor histories
    stay NULL. Every side is stored before they are joined, with what led to it removed.
    """
    fact = tables.projects.join(tables.outcomes, "projectid", "left")
    past = settled(lambda: histories(history_base(tables, s), s), "past")
    sides: list = [(past, {c: 0 for c in past.columns if c != "projectid"})]
    if text_scores is not None:
        sides.append((text_scores, None))
    donors = materialize(donor_base(tables), "donor-base")
    sides += [(settled(lambda: donor_history(donors, key), "donors"), None) for key in DONOR_KEYS]
    sides.append((materialize(resource_totals(tables), "resources"), {c: 0 for c in resource_columns()}))
    filled = star(fact, "projectid", sides)
    return filled.fillna({c: 0 for c in COUNT_LABELS.values()})


def prior_rates() -> dict[str, Column]:
    """Rate of every label for every entity: 70 columns."""
    return {
        f"{key}_{y}_prev_rate": scalars.prior_rate(F.col(f"{key}_{y}_prev"), F.col(f"{key}_cnt"))
        for y in LABELS
        for key in HISTORY_KEYS
    }


def overall_rate(labelled: DataFrame) -> Column:
    """Mean of ``y`` over train and val rows as a one-row scalar subquery."""
    used = labelled.filter(training_mask("split", include_validation=True))
    return used.agg(F.avg("y").alias("pred0")).scalar()


def credibility_rates(df: DataFrame, pred0: Column) -> DataFrame:
    """Add the overall rate ``pred0`` and the shrunk rates of teacher and school."""
    with_prior = df.withColumn("pred0", pred0)

    def shrunk(key: str) -> Column:
        return scalars.credibility_rate(
            F.col(f"{key}_y_prev"), F.col(f"{key}_cnt"), F.col("pred0"), CREDIBILITY_K
        )

    return with_prior.withColumns(
        {f"{key}_y_prev_rate_cred": shrunk(key) for key in ("schoolid", "teacher_acctid")}
    ).withColumn(
        "schoolid_y_prev_rate_cred_cap",
        scalars.clamp(F.col("schoolid_y_prev_rate_cred"), *RATE_CAP),
    )


def calendar_columns(s: FirstSettings) -> dict[str, Column]:
    day = F.col("date_posted")
    return {
        "split": dates.split_by_date(day, training_cuts(s)),
        "time": dates.days_after(day, s.time_origin),
        "log_time": dates.log_days_after(day, s.time_origin),
        "weekday": dates.weekday_name(day),
        "discount": dates.time_discount(day, s.data_end, s.discount_floor, s.discount_span),
    }


def derive(df: DataFrame, tables: Tables, s: FirstSettings) -> DataFrame:
    """All derived columns of the assembled table, in three projections.

    The overall rate is taken from projects and outcomes alone, so that the subquery does not
    run the whole assembly a second time.
    """
    split = dates.split_by_date(F.col("date_posted"), training_cuts(s))
    narrow = tables.projects.join(tables.outcomes, "projectid", "left").select(
        split.alias("split"), labels()["y"].alias("y")
    )
    price_per_student = F.try_divide("total_price_excluding_optional_support", "students_reached")
    text_columns = {
        f"{f.column}_y_pp": scalars.first_scored(
            F.col(f"{f.column}_y_pred_partial"), F.col(f"{f.column}_y_pred")
        )
        for f in s.text_fields
    }
    derived = df.withColumns(
        {
            **labels(),
            **calendar_columns(s),
            **prior_rates(),
            **text_columns,
            "poverty": scalars.ordinal(F.col("poverty_level"), POVERTY_LEVELS, 1, 0, 0),
            "grade_level_num": scalars.ordinal(F.col("grade_level"), GRADE_LEVELS, 1, 0, 0),
            "price_per_student": price_per_student,
            "students_reached_imp": F.coalesce("students_reached", F.lit(0.0)),
            "price_per_student_imp": F.coalesce(price_per_student, F.lit(0.0)),
        }
    )
    return credibility_rates(derived, overall_rate(narrow))


def text_features(tables: Tables, s: FirstSettings) -> DataFrame:
    """Text scores and lengths per project, from cleaned texts of projects after the start.

    Of several essays of a project the first counts.
    """
    cuts = history_cuts(s)
    essays = one_essay(tables.essays, keep_first)
    docs = (
        essays.join(
            tables.projects.select("projectid", "date_posted"), "projectid", "inner"
        )
        .join(tables.outcomes.select("projectid", "is_exciting"), "projectid", "left")
        .withColumn("split", dates.split_by_date(F.col("date_posted"), cuts))
        .filter(F.col("split") != "none")
    )
    columns = [f.column for f in s.text_fields]
    cleaned = materialize(
        docs.select(
            "projectid",
            "split",
            scalars.flag_or_zero(F.col("is_exciting")).alias("y"),
            *[text.clean_text(F.col(c)).alias(c) for c in columns],
        ),
        "clean-text",
    )
    scores = score_columns(
        cleaned, "projectid", "y", s.text_fields, training_mask("split"), s.folds,
        s.text_iterations,
    )
    lengths = cleaned.select(
        "projectid", *[text.word_count(F.col(c)).alias(f"{c}_length") for c in columns]
    )
    return scores.join(lengths, "projectid")


def boosted_scores(
    df: DataFrame, name: str, trees: int, s: FirstSettings, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(projectid, date_posted, score) of boosted trees trained on train and val rows."""
    keep = ["projectid", "date_posted", "split", "y"]
    inputs, numeric, categorical = learners.complete(
        df, *learners.by_kind([*TREE_FEATURES, *extra], CATEGORICAL), keep
    )
    train = inputs.filter(training_mask("split", include_validation=True))
    model = learners.fit(
        learners.boosted_trees("y", trees, 7, 0.1, 0.5, s.min_rows),
        learners.tree_inputs(numeric, categorical),
        train,
    )
    return learners.probability(model, inputs, name, ["projectid", "date_posted"])


def design(df: DataFrame) -> tuple[DataFrame, DataFrame, tuple[list[str], list[str]]]:
    """Inputs of the design rows, the codes of their levels in train and val rows, and (terms, categories)."""
    inputs, numeric, categorical = learners.complete(
        df, *learners.by_kind(MATRIX_FEATURES, CATEGORICAL), ["projectid", "split", "y"]
    )
    stored = materialize(inputs, "design-inputs")
    codes = level_codes(stored.filter(training_mask("split", include_validation=True)), categorical)
    names = [f"{f}_cat" if f in CATEGORICAL else f"{f}_imp" for f in MATRIX_FEATURES]
    return stored, codes, (names, categorical)


def forest_scores(df: DataFrame, s: FirstSettings) -> DataFrame:
    """(projectid, pred_et_v4) of the regression forest on sparse design rows."""
    inputs, codes, places = design(df)
    rows = design_rows(inputs, "projectid", *places, codes)
    matrix = learners.stored_vectors(
        inputs.select("projectid", "split", "y").join(rows, "projectid"), learners.FEATURES
    )
    model = learners.fit(
        learners.coarse_forest("y", s.trees(TREES_FOREST), 2, s.forest_min_rows, s.forest_depth),
        [],
        matrix.filter(training_mask("split", include_validation=True)),
    )
    return learners.regression(model, matrix, "pred_et_v4", ["projectid"])


def stacked_inputs(df: DataFrame, first: DataFrame, s: FirstSettings) -> DataFrame:
    """Add the trailing means of the first model's own daily scores.

    ``first`` must be a stored table: the trailing means read it again.
    """
    recent = first.filter(F.col("date_posted") >= F.lit(s.trailing_start))
    trailing = trailing_rate(recent, "date_posted", "pred_v1", TRAILING_ROWS)
    # one row per calendar day; the wide rows are not shuffled for it
    return df.join(F.broadcast(trailing.select("date_posted", *TRAILING_ROWS)), "date_posted", "left")


def blend() -> Column:
    return sum((F.col(c) * F.lit(w) for c, w in BLEND.items()), F.lit(0.0))


def run(tables: Tables, s: FirstSettings = FirstSettings()) -> DataFrame:
    """(projectid, split, single scores, is_exciting, discount) for every project.

    The submission keeps the test rows: ``run(...).filter("split = 'test'")``.
    """
    features = materialize(
        derive(assemble(tables, s, text_features(tables, s)), tables, s), "first-features"
    )
    first = materialize(
        boosted_scores(features, "pred_v1", s.trees(TREES_FIRST), s), "first-scores"
    )
    stacked = materialize(stacked_inputs(features, first, s), "stacked-features")
    result = stacked.select("projectid", "split", "discount").join(
        first.select("projectid", "pred_v1"), "projectid"
    )
    for name, trailing in STACKED.items():
        scored = boosted_scores(stacked, name, s.trees(TREES_STACKED), s, (trailing,))
        result = result.join(scored.select("projectid", name), "projectid")
    result = result.join(forest_scores(stacked, s), "projectid")
    return result.withColumn("is_exciting", blend())
