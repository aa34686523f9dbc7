"""Second scoring plan: calendar neighbourhoods, lags, target encoding, maturity factor."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.functions import dates, scalars, text
from lagwise.operators import assemble
from lagwise.operators.calendar import attach_by_day, around, daily_mean, day_profile
from lagwise.operators.curve import attach_factor, maturity_curve
from lagwise.operators.encode import Encoding, target_encode_all
from lagwise.operators.lookback import Prior, look_back
from lagwise.plans import learners
from lagwise.plans.text_scores import SECOND_SCHEME, TextField, refitted_columns
from lagwise.session import materialize, settled
from lagwise.sources.tables import Tables, one_essay

# --- fixed values: flags, codes, encodings, features, sizes ------------------------------
STRICT_FLAGS = [
    "at_least_1_teacher_referred_donor", "at_least_1_green_donation",
    "three_or_more_non_teacher_referred_donors",
    "one_non_teacher_referred_donor_giving_100_plus", "donation_from_thoughtful_donor",
]
NULLABLE_FLAGS = ["fully_funded", "great_chat"]
DONATION_FLAGS = [
    "is_teacher_acct", "payment_included_acct_credit",
    "payment_included_campaign_gift_card", "payment_included_web_purchased_gift_card",
    "payment_was_promo_matched", "via_giving_page", "for_honoree",
]
TEACHER_PREFIXES = ["Dr.", "Mr.", "Mr. & Mrs.", "Mrs.", "Ms."]
RESOURCE_LEVELS = ["Books", "Other", "Supplies", "Technology", "Trips", "Visitors"]
SCHOOL_TYPES = [
    "1-Regular school", "2-Special education school", "3-Vocational school",
    "4-Alternative/other school",
]
NOISE = 0.3
ENCODINGS = (
    Encoding("adj_teacher_acctid", ("teacher_acctid",), 5, NOISE),
    Encoding("adj_school_ncesid", ("school_ncesid",), 25, NOISE),
    Encoding("adj_school_state", ("school_state",), 25, NOISE),
    Encoding("adj_subject", ("primary_focus_subject", "secondary_focus_subject"), 20, NOISE),
    Encoding(
        "adj_primary_focus_subject_resource_type",
        ("primary_focus_subject", "resource_type"), 25, NOISE,
    ),
    Encoding(
        "adj_secondary_focus_subject_resource_type",
        ("secondary_focus_subject", "resource_type"), 25, NOISE,
    ),
)
LOGS = {
    "adj_teacher_acctid_ln": ("adj_teacher_acctid", 0),
    "students_reached_v2_ln": ("students_reached_v2", 2),
    "total_price_excluding_optional_support_ln": ("total_price_excluding_optional_support", 0),
    "cnt_bwk_city_ln": ("cnt_bwk_city", 0),
    "cnt_wk_city_ln": ("cnt_wk_city", 0),
    "cnt_mth_city_ln": ("cnt_wk_city", 0),
    "cnt_mth_zip_ln": ("cnt_mth_zip", 0),
    "cnt_bwk_zip_ln": ("cnt_bwk_zip", 0),
    "cnt_wk_zip_ln": ("cnt_wk_zip", 0),
    "cnt_mth_schoolid_ln": ("cnt_mth_schoolid", 0),
    "cnt_bwk_schoolid_ln": ("cnt_bwk_schoolid", 0),
    "cnt_wk_schoolid_ln": ("cnt_wk_schoolid", 0),
    "days_since_prev_schoolid_v2_ln": ("days_since_prev_schoolid_v2", 2),
    "i_price_per_day_schoolid_ln": ("i_price_per_day_schoolid", 1),
    "title_cnt_ln": ("title_cnt", 1),
    "essay_cnt_ln": ("essay_cnt", 1),
    "cnt_donations_schoolid_cumsum_ln": ("cnt_donations_schoolid_cumsum", 1),
}
IMPUTED = {
    "i_price_dec_over_min_school_zip": 0, "i_price_school_city_cummax": 0,
    "days_since_prev_school_city": -1, "i_price_prev_dif_schoolid": 0,
    "days_since_prev_schoolid": -1, "students_reached": -1,
}
BOOSTED_FEATURES = [
    "adj_teacher_acctid", "adj_school_ncesid", "adj_school_state",
    "adj_primary_focus_subject_resource_type", "adj_secondary_focus_subject_resource_type",
    "price_school_city", "school_latitude", "school_longitude", "teacher_prefix",
    "teacher_teach_for_america", "students_reached", "eligible_double_your_impact_match",
    "eligible_almost_home_match", "total_price_excluding_optional_support", "books_cnt",
    "cnt_bwk_city", "cnt_wk_city", "cnt_mth_zip", "cnt_bwk_zip", "cnt_wk_zip",
    "cnt_mth_schoolid", "cnt_bwk_schoolid", "cnt_wk_schoolid", "days_since_prev_schoolid",
    "i_price_prev_dif_schoolid", "optional_support_mean_school_city",
    "days_since_prev_school_city", "price_schoolid", "optional_support",
    "i_price_per_day_schoolid", "i_price_school_city_cummax", "i_price_dec_over_min_school_zip",
    "title_cnt", "essay_cnt", "resource_type", "school_type", "cnt_donations_schoolid_cumsum",
    "cnt_donations_teacher_acctid_cumsum", "essay_tfidf",
]
FOREST_FEATURES = [
    "adj_teacher_acctid", "adj_school_ncesid", "adj_school_state",
    "adj_primary_focus_subject_resource_type", "adj_secondary_focus_subject_resource_type",
    "price_school_city", "school_latitude", "school_longitude", "teacher_prefix",
    "teacher_teach_for_america", "students_reached_v2", "eligible_double_your_impact_match",
    "eligible_almost_home_match", "total_price_excluding_optional_support", "books_cnt",
    "cnt_bwk_city", "cnt_wk_city", "cnt_mth_zip", "cnt_bwk_zip", "cnt_wk_zip",
    "cnt_mth_schoolid", "cnt_bwk_schoolid", "cnt_wk_schoolid", "days_since_prev_schoolid_v2",
    "i_price_prev_dif_schoolid_v2", "optional_support_mean_school_city",
    "days_since_prev_school_city_v2", "price_schoolid", "optional_support",
    "i_price_per_day_schoolid", "i_price_school_city_cummax_v2",
    "i_price_dec_over_min_school_zip_v2", "title_cnt", "essay_cnt", "resource_type",
    "school_type_v2", "cnt_donations_schoolid_cumsum", "cnt_donations_teacher_acctid_cumsum",
    "essay_tfidf",
]
MATRIX_FEATURES = [
    "adj_teacher_acctid", "adj_school_ncesid", "adj_school_state",
    "adj_primary_focus_subject_resource_type", "adj_secondary_focus_subject_resource_type",
    "price_school_city", "school_latitude", "school_longitude", "teacher_prefix_v2",
    "teacher_teach_for_america_v2", "students_reached_v2",
    "eligible_double_your_impact_match_v2", "eligible_almost_home_match_v2",
    "total_price_excluding_optional_support", "books_cnt", "cnt_bwk_city", "cnt_wk_city",
    "cnt_mth_zip", "cnt_bwk_zip", "cnt_wk_zip", "cnt_mth_schoolid", "cnt_bwk_schoolid",
    "cnt_wk_schoolid", "days_since_prev_schoolid_v2", "i_price_prev_dif_schoolid_v2",
    "optional_support_mean_school_city", "days_since_prev_school_city_v2", "price_schoolid",
    "optional_support", "i_price_per_day_schoolid", "i_price_school_city_cummax_v2",
    "i_price_dec_over_min_school_zip_v2", "title_cnt", "essay_cnt", "resource_type_v2",
    "school_type_v3", "cnt_donations_schoolid_cumsum", "cnt_donations_teacher_acctid_cumsum",
    "essay_tfidf",
]
LOG_FEATURES = [
    "adj_teacher_acctid_ln", "adj_school_ncesid", "adj_school_state",
    "adj_primary_focus_subject_resource_type", "adj_secondary_focus_subject_resource_type",
    "price_school_city", "school_latitude", "school_longitude", "teacher_prefix_v2",
    "teacher_teach_for_america_v2", "students_reached_v2_ln",
    "eligible_double_your_impact_match_v2", "eligible_almost_home_match_v2",
    "total_price_excluding_optional_support_ln", "books_cnt", "cnt_bwk_city_ln",
    "cnt_wk_city_ln", "cnt_mth_zip_ln", "cnt_bwk_zip_ln", "cnt_wk_zip_ln",
    "cnt_mth_schoolid_ln", "cnt_bwk_schoolid_ln", "cnt_wk_schoolid_ln",
    "days_since_prev_schoolid_v2_ln", "i_price_prev_dif_schoolid_v2",
    "optional_support_mean_school_city", "days_since_prev_school_city_v2", "price_schoolid",
    "optional_support", "i_price_per_day_schoolid_ln", "i_price_school_city_cummax_v2",
    "i_price_dec_over_min_school_zip_v2", "title_cnt_ln", "essay_cnt_ln", "resource_type_v2",
    "school_type_v3", "cnt_donations_schoolid_cumsum_ln", "cnt_donations_teacher_acctid_cumsum",
    "essay_tfidf",
]
CATEGORICAL = {
    "teacher_prefix", "teacher_teach_for_america", "eligible_double_your_impact_match",
    "eligible_almost_home_match", "resource_type", "school_type", "school_type_v2",
}
BLEND = {"pred_day_gbm": 1.0, "pred_day_et": 1.0, "pred_day_glmnet": 0.0, "pred_day_rf": 0.2}
BLEND_TOTAL = 2.2
LOWEST_PENALTY = 0.005
TREES_BOOSTED, TREES_FOREST, TREES_COARSE = 7300, 5000, 3000
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SecondSettings:
    """Dates and sizes; the defaults are the original ones."""

    start: dt.date = dt.date(2010, 4, 1)
    train_start: dt.date = dt.date(2011, 1, 1)
    validation: dt.date = dt.date(2013, 7, 1)
    test: dt.date = dt.date(2014, 1, 1)
    cohort_start: dt.date = dt.date(2013, 10, 1)
    cohort_end: dt.date = dt.date(2014, 1, 1)
    data_end: dt.date = dt.date(2014, 5, 12)
    longest_age: int = 120
    boost_share: float = 1.0
    boost_rate: float = 0.01
    tree_share: float = 1.0
    forest_depth: int = 30
    penalty_folds: int = 10
    penalties: int = 100
    folds: int = 10
    text_fields: tuple[TextField, ...] = field(default=SECOND_SCHEME)
    text_iterations: int = learners.ITERATIONS

    def trees(self, full: int) -> int:
        return max(1, round(full * self.tree_share))


def labelled(tables: Tables, s: SecondSettings) -> DataFrame:
    """Projects from the start on with three-valued outcome flags and the split columns."""
    joined = tables.projects.join(tables.outcomes, "projectid", "left")
    last = tables.projects.agg(F.max("date_posted").alias("last")).scalar()
    day = F.col("date_posted")
    flags = {c: scalars.flag_strict(F.col(c)) for c in STRICT_FLAGS}
    flags |= {c: scalars.flag_keep_null(F.col(c)) for c in NULLABLE_FLAGS}
    return joined.filter(day >= F.lit(s.start)).withColumns(
        {
            **flags,
            "y": scalars.flag_keep_null(F.col("is_exciting")),
            "test": (day >= F.lit(s.test)).cast("int"),
            "validation": (day >= F.lit(s.validation)).cast("int"),
            "last_date_posted": last,
            "ym": dates.year_month(day),
            "days_since_posted": F.datediff(last, day),
            "optional_support": F.col("total_price_including_optional_support")
            - F.col("total_price_excluding_optional_support"),
        }
    )


def project_list(d: DataFrame) -> DataFrame:
    """(projectid, validation, test, y): what the text job needs from the project rows."""
    return d.select("projectid", "validation", "test", "y")


def routed_essays(tables: Tables, projects: DataFrame) -> DataFrame:
    """Essays of listed projects with their split; the last copy of an essay counts."""
    split = (
        F.when(F.col("validation") == 0, "train")
        .when(F.col("test") == 0, "validation")
        .otherwise("test")
    )
    essays = one_essay(tables.essays, assemble.keep_last)
    return essays.join(projects, "projectid", "inner").withColumn("split", split)


def scored_texts(docs: DataFrame, s: SecondSettings) -> DataFrame:
    """(projectid, <field>_tfidf of every text field) of routed essays, cleaned first.

    NUL characters go and literal escapes become blanks before a text is split, or they would cut
    words in two or add letters to them.
    """
    fields = [f.column for f in s.text_fields]
    cleaned = docs.select(
        "projectid", "y", "split", *[text.clean_text(text.strip_nul(F.col(c))).alias(c) for c in fields]
    )
    return refitted_columns(cleaned, "projectid", "y", "split", s.text_fields, s.folds, s.text_iterations)


def token_counts(essays: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Words of the four raw text fields per project; the first copy of an essay counts.

    ``more`` names further columns to take from that copy.
    """
    names = ["title", "short_description", "need_statement", "essay"]
    return one_essay(essays, assemble.keep_first).select(
        "projectid",
        *[text.word_count(text.strip_nul(F.col(c))).alias(f"{c}_cnt") for c in names],
        *[column.alias(name) for name, column in (more or {}).items()],
    )


def donation_summary(donations: DataFrame) -> DataFrame:
    """(projectid, project_donations_cnt, max_donation_date)."""
    day = F.to_date(F.substring(F.col("donation_timestamp").cast("string"), 1, 10))
    return donations.groupBy("projectid").agg(
        F.count(F.lit(1)).alias("project_donations_cnt"), F.max(day).alias("max_donation_date")
    )


def donation_flags(donations: DataFrame) -> DataFrame:
    return donations.withColumns(
        {c: scalars.flag_keep_null(F.col(c)) for c in DONATION_FLAGS}
    )


def funding_curve(d: DataFrame, s: SecondSettings) -> DataFrame:
    """Maturity curve of the funded projects of the cohort period."""
    cohort = d.filter(
        (F.col("date_posted") >= F.lit(s.cohort_start))
        & (F.col("date_posted") < F.lit(s.cohort_end))
        & (F.col("fully_funded") == 1)
    ).withColumn("days_to_fully_funding", F.datediff("max_donation_date", "date_posted"))
    return maturity_curve(cohort, "days_to_fully_funding", "y", s.longest_age)


def _whole(key: str):
    return W.partitionBy(key)


def _before(key: str):
    return W.partitionBy(key).orderBy("date_posted").rowsBetween(W.unboundedPreceding, -1)


def _strict_mean(total: str, known: str, key: str) -> Column:
    """Mean over the whole entity from daily sums; NULL if any value was missing."""
    rows, used = F.sum("_n").over(_whole(key)), F.sum(known).over(_whole(key))
    return F.when(rows == used, F.try_divide(F.sum(total).over(_whole(key)), used))


def _neighbours(key: str, suffix: str) -> list[Column]:
    return [
        F.sum("_n").over(around(key, "date_posted", -reach, reach)).alias(f"cnt_{name}_{suffix}")
        for name, reach in (("wk", 3), ("bwk", 6))
    ]


def _month(key: str, suffix: str) -> Column:
    per_month = W.partitionBy(key, dates.year_month(F.col("date_posted")))
    return F.sum("_n").over(per_month).alias(f"cnt_mth_{suffix}")


PRICE = "total_price_including_optional_support"
BASE_PRICE = "total_price_excluding_optional_support"


def teacher_features(d: DataFrame) -> DataFrame:
    key = "teacher_acctid"
    profile = day_profile(d, [key], "date_posted", _d=F.sum("_donations")).select(
        key,
        "date_posted",
        F.coalesce(F.sum("_d").over(_before(key)), F.lit(0)).alias(
            "cnt_donations_teacher_acctid_cumsum"
        ),
    )
    rows = d.select("projectid", key, "date_posted")
    return attach_by_day(rows, profile, [key], "date_posted").drop(key, "date_posted")


def school_features(d: DataFrame) -> DataFrame:
    key = "schoolid"
    days_open = F.datediff("last_date_posted", F.min("date_posted").over(_whole(key)))
    profile = day_profile(
        d,
        [key],
        "date_posted",
        _n=F.count(F.lit(1)),
        _d=F.sum("_donations"),
        _total=F.sum(PRICE),
        _base=F.sum(BASE_PRICE),
        _base_known=F.count(BASE_PRICE),
        last_date_posted=F.first("last_date_posted"),
    ).select(
        key,
        "date_posted",
        *_neighbours(key, "schoolid"),
        _month(key, "schoolid"),
        F.coalesce(F.sum("_d").over(_before(key)), F.lit(0)).alias(
            "cnt_donations_schoolid_cumsum"
        ),
        F.try_divide(
            F.coalesce(F.sum("_total").over(_whole(key)), F.lit(0.0)), days_open
        ).alias("i_price_per_day_schoolid"),
        _strict_mean("_base", "_base_known", key).alias("price_schoolid"),
    )
    past = look_back(
        d, key, "date_posted", "projectid", [Prior("_previous", "last", PRICE)], keep=[PRICE]
    ).select(
        "projectid",
        key,
        "date_posted",
        F.datediff("date_posted", "last_day").alias("days_since_prev_schoolid"),
        (F.col(PRICE) - F.col("_previous")).alias("i_price_prev_dif_schoolid"),
    )
    return attach_by_day(past, profile, [key], "date_posted").drop(key, "date_posted")


def city_features(d: DataFrame) -> DataFrame:
    key = "school_city"
    profile = day_profile(
        d,
        [key],
        "date_posted",
        _n=F.count(F.lit(1)),
        _base=F.sum(BASE_PRICE),
        _base_known=F.count(BASE_PRICE),
        _support=F.sum("optional_support"),
        _support_known=F.count("optional_support"),
    ).select(
        key,
        "date_posted",
        *_neighbours(key, "city"),
        _strict_mean("_base", "_base_known", key).alias("price_school_city"),
        F.try_divide(
            F.sum("_support").over(_whole(key)), F.sum("_support_known").over(_whole(key))
        ).alias("optional_support_mean_school_city"),
    )
    past = look_back(
        d, key, "date_posted", "projectid", [Prior("i_price_school_city_cummax", "max", PRICE)]
    ).select(
        "projectid",
        key,
        "date_posted",
        F.datediff("date_posted", "last_day").alias("days_since_prev_school_city"),
        "i_price_school_city_cummax",
    )
    return attach_by_day(past, profile, [key], "date_posted").drop(key, "date_posted")


def zip_features(d: DataFrame) -> DataFrame:
    key = "school_zip"
    profile = day_profile(d, [key], "date_posted", _n=F.count(F.lit(1))).select(
        key, "date_posted", *_neighbours(key, "zip"), _month(key, "zip")
    )
    past = look_back(
        d, key, "date_posted", "projectid", [Prior("_lowest", "min", PRICE)], keep=[PRICE]
    ).select(
        "projectid",
        key,
        "date_posted",
        (F.col("_lowest") - F.col(PRICE)).alias("i_price_dec_over_min_school_zip"),
    )
    return attach_by_day(past, profile, [key], "date_posted").drop(key, "date_posted")


def codes() -> dict[str, Column]:
    flags = [
        "teacher_teach_for_america", "eligible_double_your_impact_match",
        "eligible_almost_home_match",
    ]
    return {
        "teacher_prefix_v2": scalars.ordinal(F.col("teacher_prefix"), TEACHER_PREFIXES, 1, 0),
        "resource_type_v2": scalars.ordinal(F.col("resource_type"), RESOURCE_LEVELS, 1, 0),
        "school_type_v2": scalars.label_blank(F.col("school_type"), "_NA_"),
        "school_type_v3": scalars.ordinal(F.col("school_type"), SCHOOL_TYPES, 1, 0),
        **{f"{c}_v2": scalars.flag_strict(F.col(c)) for c in flags},
    }


def imputed() -> dict[str, Column]:
    return {f"{c}_v2": F.coalesce(F.col(c), F.lit(v)) for c, v in IMPUTED.items()}


def logs() -> dict[str, Column]:
    return {name: scalars.log_offset(F.col(c), o) for name, (c, o) in LOGS.items()}


def features(
    tables: Tables, s: SecondSettings, counts: DataFrame, text_scores: DataFrame
) -> DataFrame:
    """One row per project with every model input, plus the maturity factor."""
    gifts = donation_summary(tables.donations)
    joined = labelled(tables, s).join(gifts, "projectid", "left")
    base = materialize(
        joined.withColumns(
            {
                "_donations": F.coalesce("project_donations_cnt", F.lit(0)),
                "project_donations_cnt": F.when(
                    F.col("project_donations_cnt").isNull() & (F.col("test") == 0), F.lit(0)
                ).otherwise(F.col("project_donations_cnt")),
            }
        ),
        "second-base",
    )
    held = tables.resources.join(base.select("projectid"), "projectid", "inner")
    price = F.col("item_unit_price") * F.col("item_quantity")
    resources = assemble.resource_summary(held, "projectid", price, "item_quantity", "project_resource_type")
    # every side is stored before they are joined, so that disk holds the shuffles of one at a time
    wide = assemble.star(
        base.join(tables.schools, "school_ncesid", "left"),
        "projectid",
        [
            (counts, None),
            (text_scores, None),
            (materialize(resources, "resources"), None),
            *[
                (settled(lambda: side(base), "side"), None)
                for side in (teacher_features, school_features, city_features, zip_features)
            ],
        ],
    )
    known = F.col("test") == 0
    prior = base.filter(known).agg(F.avg("y").alias("p")).scalar()
    keys = list(dict.fromkeys(k for e in ENCODINGS for k in e.keys))
    encoded = target_encode_all(
        base.select("projectid", "y", "test", *keys).withColumn("p", prior),
        "projectid", "y", "p", known, ENCODINGS,
    )
    coded = wide.join(materialize(encoded, "encoded"), "projectid", "left").withColumns({**imputed(), **codes()})
    curve = materialize(funding_curve(base, s), "funding-curve")
    return attach_factor(
        coded.withColumns(logs()), "days_since_posted", curve, "days_to_fully_funding"
    )


def _training(df: DataFrame, s: SecondSettings) -> DataFrame:
    return df.filter(
        (F.col("test") == 0)
        & (F.col("date_posted") >= F.lit(s.train_start))
        & F.col("y").isNotNull()
    )


KEEP = ["projectid", "date_posted", "test", "y"]


def boosted_scores(df: DataFrame, s: SecondSettings) -> DataFrame:
    inputs, numeric, categorical = learners.complete(
        df, *learners.by_kind(BOOSTED_FEATURES, CATEGORICAL), KEEP
    )
    trees = max(1, round(TREES_BOOSTED * s.boost_share * s.tree_share))
    model = learners.fit(
        learners.boosted_trees("y", trees, 6, s.boost_rate, 0.5, 100),
        learners.tree_inputs(numeric, categorical),
        _training(inputs, s),
    )
    return learners.probability(model, inputs, "pred_day_gbm", ["projectid"])


def forest_scores(df: DataFrame, s: SecondSettings) -> DataFrame:
    inputs, numeric, categorical = learners.complete(
        df, *learners.by_kind(FOREST_FEATURES, CATEGORICAL), KEEP
    )
    model = learners.fit(
        learners.random_forest("y", s.trees(TREES_FOREST), 2, 10, s.forest_depth),
        learners.tree_inputs(numeric, categorical),
        _training(inputs, s),
    )
    return learners.probability(model, inputs, "pred_day_rf", ["projectid"])


def coarse_scores(df: DataFrame, s: SecondSettings) -> DataFrame:
    inputs, numeric, _ = learners.complete(df, MATRIX_FEATURES, [], KEEP)
    model = learners.fit(
        learners.coarse_forest("y", s.trees(TREES_COARSE), 2, 100, s.forest_depth),
        learners.tree_inputs(numeric, []),
        _training(inputs, s),
    )
    return learners.regression(model, inputs, "pred_day_et", ["projectid"])


def ridge_scores(df: DataFrame, s: SecondSettings) -> DataFrame:
    inputs, numeric, _ = learners.complete(df, LOG_FEATURES, [], KEEP)
    train = _training(inputs, s)
    path = learners.penalty_path(
        learners.largest_penalty(train, numeric, "y"), LOWEST_PENALTY, s.penalties
    )
    model = learners.fit(
        learners.ridge_cv("y", path, s.penalty_folds), learners.tree_inputs(numeric, []), train
    )
    return learners.probability(model, inputs, "pred_day_glmnet", ["projectid"])


def blend() -> Column:
    total = sum((F.col(c) * F.lit(w) for c, w in BLEND.items()), F.lit(0.0))
    return total / F.lit(BLEND_TOTAL)


def apply_factor(pred: Column, factor: Column) -> Column:
    """Multiply by the maturity factor where the age has one."""
    return F.when(factor.isNotNull(), pred * factor).otherwise(pred)


def run(tables: Tables, s: SecondSettings = SecondSettings()) -> DataFrame:
    """(projectid, date_posted, test, single scores, pred_day, is_exciting) for every project."""
    d = labelled(tables, s)
    docs = materialize(routed_essays(tables, project_list(d)), "routed-essays")
    table = materialize(
        features(tables, s, token_counts(tables.essays), scored_texts(docs, s)), "second-features"
    )
    result = table.select("projectid", "date_posted", "test", "factor")
    for scored in (
        boosted_scores(table, s), forest_scores(table, s), coarse_scores(table, s),
        ridge_scores(table, s),
    ):
        result = result.join(scored, "projectid")
    return result.withColumn("pred_day", blend()).withColumn(
        "is_exciting", apply_factor(F.col("pred_day"), F.col("factor"))
    )


def daily_report(scored: DataFrame, s: SecondSettings, column: str = "is_exciting") -> DataFrame:
    return daily_mean(scored, "date_posted", column, s.data_end)
