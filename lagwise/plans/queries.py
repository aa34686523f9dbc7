"""Registered queries: every operator run over the whole test tables.

Doubles are rounded at the edge so that the order of a sum cannot change a result. The shift
before rounding (see ``rounded``) is part of the queries only, not of the operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions import dates, scalars, text
from lagwise.operators import assemble, calendar, encode, evaluate, levels, lookback, lookup
from lagwise.operators import tfidf as terms
from lagwise.operators.splits import training_mask
from lagwise.plans import final, first, learners, oracle, second, text_scores
from lagwise.session import fresh_path, materialize, settled
from lagwise.sources import fixtures, tables

# Dates and node sizes follow from the test tables. Numbers of trees, folds, penalties and steps of
# the text fits and the depth of forests are below the defaults of the plans here: the full fits take hours on one
# machine. Texts, fields, n-grams, features and rows are never cut.
FIRST = first.FirstSettings(
    history_start=dt.date(1995, 7, 1),
    text_validation=dt.date(2000, 1, 1),
    train_start=dt.date(1995, 10, 1),
    validation=dt.date(2000, 6, 1),
    test=dt.date(2001, 1, 1),
    trailing_start=dt.date(1995, 9, 1),
    time_origin=dt.date(1995, 6, 30),
    data_end=dt.date(2001, 8, 20),
    tree_share=0.01,
    min_rows=20,
    forest_min_rows=20,
    forest_depth=6,
    folds=2,
    text_iterations=20,
)
SECOND = second.SecondSettings(
    start=dt.date(1995, 7, 1),
    train_start=dt.date(1996, 1, 1),
    validation=dt.date(2000, 1, 1),
    test=dt.date(2001, 1, 1),
    cohort_start=dt.date(1999, 1, 1),
    cohort_end=dt.date(2001, 1, 1),
    data_end=dt.date(2001, 8, 20),
    tree_share=0.01,
    forest_depth=6,
    penalty_folds=2,
    penalties=3,
    folds=2,
    text_iterations=20,
)
PRICE = "total_price_excluding_optional_support"
TIE_SHIFT = oracle.TIE_SHIFT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def posted() -> Column:
    return F.col("date_posted")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(name: str | Column, digits: int = 6) -> Column:
    """Round after shifting by an eighth of the last place.

    Sums of money often end exactly on a rounding tie, where the order of a floating-point sum
    would decide; shifted, no such value is near a tie.
    """
    value = F.col(name) if isinstance(name, str) else name
    return F.round(value + F.lit(TIE_SHIFT * 10.0**-digits), digits)


def text_day(column: str = "date_posted") -> Column:
    return F.col(column).cast("string").alias(column)


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Feature tables several model queries share, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        rows = fixtures.source(spark, folder, "orders").count()
        _STORED[key] = settled(build, name, "projectid", rows)
    return _STORED[key]


def second_base(spark: SparkSession, folder: str) -> DataFrame:
    return second.labelled(fixtures.load(spark, folder), SECOND)


def stored_base(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of the labelled rows, written once for queries that read them often."""
    return materialize(second_base(spark, folder).select("projectid", *columns), "base")


# --- sources and sinks --------------------------------------------------------------------


@query
def scan_projects(spark, folder):
    path = fresh_path(spark, "projects-csv")
    tables.write_csv(fixtures.projects(spark, folder), path)
    scanned = tables.read_csv(spark, path, tables.PROJECTS)
    return scanned.withColumn("date_posted", text_day())


@query
def scan_essays(spark, folder):
    path = fresh_path(spark, "essays-csv")
    tables.write_csv(fixtures.essays(spark, folder), path)
    return tables.read_csv(spark, path, tables.ESSAYS, multiline=True)


@query
def text_strip_nul(spark, folder):
    dirty = F.regexp_replace(F.translate("text", "q", "\u0000"), "\n", "\r\n")
    return fixtures.source(spark, folder, "documents").select(
        "doc_id", text.strip_nul(dirty).alias("text")
    )


@query
def submission(spark, folder):
    scored = fixtures.projects(spark, folder).select(
        "projectid", dates.split_by_date(posted(), first.training_cuts(FIRST)).alias("split"),
        rounded(dates.time_discount(posted(), FIRST.data_end)).alias("is_exciting"),
    )
    path = fresh_path(spark, "submission-csv")
    tables.write_submission(
        scored.filter(F.col("split") == "test"), path, ["projectid", "is_exciting"]
    )
    return tables.read_csv(spark, path, "projectid BIGINT, is_exciting DOUBLE")


@query
def dim_school_type(spark, folder):
    loaded = fixtures.load(spark, folder)
    renamed = tables.school_types(loaded.schools, type_column="school_type")
    return (
        loaded.projects.select("projectid", F.col("school_ncesid").cast("string"))
        .join(renamed, "school_ncesid", "left")
        .select("projectid", "school_ncesid", "school_type")
    )


def _padded(spark, folder):
    return fixtures.projects(spark, folder).select(
        F.concat(F.lit(" "), F.col("teacher_acctid"), F.lit("  ")).alias("raw_id"),
        "projectid", "school_metro", text_day(),
    )


@query
def dedup_first(spark, folder):
    padded = _padded(spark, folder)
    return assemble.keep_first(padded, F.trim("raw_id"), "account", "projectid").drop("raw_id")


@query
def dedup_last(spark, folder):
    padded = _padded(spark, folder)
    return assemble.keep_last(padded, F.trim("raw_id"), "account", "projectid").drop("raw_id")


@query
def project_list(spark, folder):
    return second.project_list(second_base(spark, folder))


# --- projection, splits, labels, encodings --------------------------------------------------


@query
def derived_prices(spark, folder):
    return fixtures.projects(spark, folder).select(
        "projectid",
        rounded(
            F.col("total_price_including_optional_support") - F.col(PRICE), 4
        ).alias("optional_support"),
        rounded(F.try_divide(PRICE, "students_reached")).alias("price_per_student"),
    )


@query
def split_assign(spark, folder):
    return fixtures.projects(spark, folder).select(
        "projectid",
        dates.split_by_date(posted(), first.history_cuts(FIRST)).alias("history_split"),
        dates.split_by_date(posted(), first.training_cuts(FIRST)).alias("training_split"),
        (posted() >= F.lit(SECOND.validation)).cast("int").alias("validation"),
        (posted() >= F.lit(SECOND.test)).cast("int").alias("test"),
    )


def _first_labels(spark, folder):
    loaded = fixtures.load(spark, folder)
    return loaded.projects.join(loaded.outcomes, "projectid", "left").withColumns(first.labels())


@query
def train_mask(spark, folder):
    df = _first_labels(spark, folder).withColumn(
        "split", dates.split_by_date(posted(), first.history_cuts(FIRST))
    )
    return df.select(
        "projectid",
        training_mask("split").cast("int").alias("train_only"),
        training_mask("split", True).cast("int").alias("with_val"),
        training_mask("split", True, ["y4", "y5"]).cast("int").alias("with_givens"),
    )


@query
def labels(spark, folder):
    return _first_labels(spark, folder).select("projectid", *first.LABELS)


@query
def labels_3v(spark, folder):
    flags = second_base(spark, folder).select(
        "projectid", "y", *second.STRICT_FLAGS, *second.NULLABLE_FLAGS
    )
    gifts = second.donation_flags(fixtures.donations(spark, folder))
    per_project = gifts.groupBy("projectid").agg(
        *[F.sum(c).cast("bigint").alias(f"{c}_sum") for c in second.DONATION_FLAGS],
        *[F.count(c).alias(f"{c}_known") for c in second.DONATION_FLAGS],
    )
    return flags.join(per_project, "projectid", "left")


@query
def ordinal_encode(spark, folder):
    loaded = fixtures.load(spark, folder)
    df = loaded.projects.join(loaded.schools, "school_ncesid", "left")
    return df.select(
        "projectid",
        scalars.ordinal(F.col("poverty_level"), first.POVERTY_LEVELS, 1, 0, 0).alias("poverty"),
        scalars.ordinal(F.col("grade_level"), first.GRADE_LEVELS, 1, 0, 0).alias(
            "grade_level_num"
        ),
        *[c.alias(n) for n, c in second.codes().items()],
    )


@query
def date_parts(spark, folder):
    return fixtures.projects(spark, folder).select(
        "projectid",
        F.year(posted()).alias("year"),
        F.month(posted()).alias("month"),
        F.dayofmonth(posted()).alias("day"),
        dates.year_month(posted()).alias("ym"),
        dates.weekday_name(posted()).alias("weekday"),
        dates.days_after(posted(), FIRST.time_origin).alias("time"),
        rounded(dates.log_days_after(posted(), FIRST.time_origin)).alias("log_time"),
        F.to_date(F.substring(posted().cast("timestamp").cast("string"), 1, 10))
        .cast("string")
        .alias("from_timestamp"),
    )


@query
def time_discount(spark, folder):
    return fixtures.projects(spark, folder).select(
        "projectid", rounded(dates.time_discount(posted(), FIRST.data_end)).alias("discount")
    )


@query
def fold_assign(spark, folder):
    u = scalars.uniform_from_id(F.col("projectid"), "fold")
    return fixtures.projects(spark, folder).select(
        "projectid",
        rounded(u).alias("u"),
        scalars.even_fold(u, 10).alias("even_fold"),
        scalars.descending_fold(u, 10).alias("descending_fold"),
    )


# --- histories and lags -------------------------------------------------------------------


@query
def entity_history(spark, folder):
    base = first.history_base(fixtures.load(spark, folder), FIRST)
    counted = posted() < F.lit(FIRST.test)
    result = base.select("projectid")
    for key in ("teacher_acctid", "school_district"):
        past = lookback.entity_history(
            base, key, "date_posted", "projectid", first.LABELS, counted
        ).drop(key, "date_posted")
        result = result.join(past, "projectid")
    return result


@query
def donor_rollup(spark, folder):
    return first.donor_base(fixtures.load(spark, folder)).select(
        "projectid", text_day(), "teacher_acctid", "schoolid", "school_district", "school_city",
        "school_zip", "y11", "y12", rounded("y13", 2).alias("y13"),
    )


@query
def donor_history(spark, folder):
    base = materialize(first.donor_base(fixtures.load(spark, folder)), "donor-base")
    teacher, school = first.donor_histories(base).values()
    joined = teacher.join(school, "projectid")
    return joined.withColumns(
        {f"{k}_y13_prev": rounded(f"{k}_y13_prev", 2) for k in first.DONOR_KEYS}
    )


@query
def lag_features(spark, folder):
    base = stored_base(
        spark, folder, "date_posted", "schoolid", "school_district", second.PRICE
    )
    full = second.PRICE
    school = lookback.lag_features(
        base, "schoolid", "date_posted", "projectid", full,
        "days_since_prev_schoolid", "i_price_prev_dif_schoolid",
    )
    district = lookback.lag_features(
        base, "school_district", "date_posted", "projectid", full,
        "days_since_prev_district", "i_price_prev_dif_district",
    )
    return school.join(district, "projectid").withColumns(
        {
            c: rounded(c, 4)
            for c in ("i_price_prev_dif_schoolid", "i_price_prev_dif_district")
        }
    )


@query
def prior_extremes(spark, folder):
    base = stored_base(
        spark, folder, "date_posted", "school_city", "school_zip", second.PRICE
    )
    full = second.PRICE
    highest = lookback.prior_extreme(
        base, "school_city", "date_posted", "projectid", full, "max", "i_price_school_city_cummax"
    )
    lowest = lookback.prior_extreme(
        base, "school_zip", "date_posted", "projectid", full, "min", "i_price_school_zip_cummin"
    )
    return (
        base.select("projectid", full)
        .join(highest, "projectid")
        .join(lowest, "projectid")
        .select(
            "projectid",
            rounded("i_price_school_city_cummax", 4).alias("i_price_school_city_cummax"),
            rounded("i_price_school_zip_cummin", 4).alias("i_price_school_zip_cummin"),
            rounded(F.col("i_price_school_zip_cummin") - F.col(full), 4).alias(
                "i_price_dec_over_min_school_zip"
            ),
        )
    )


@query
def prior_rates(spark, folder):
    base = first.history_base(fixtures.load(spark, folder), FIRST)
    return first.histories(base, FIRST).select(
        "projectid", *[rounded(rate).alias(name) for name, rate in first.prior_rates().items()]
    )


@query
def credibility_rate(spark, folder):
    base = first.history_base(fixtures.load(spark, folder), FIRST)
    joined = first.histories(base, FIRST)
    names = [
        "pred0", "teacher_acctid_y_prev_rate_cred", "schoolid_y_prev_rate_cred",
        "schoolid_y_prev_rate_cred_cap",
    ]
    labelled = base.select(
        "y", dates.split_by_date(posted(), first.training_cuts(FIRST)).alias("split")
    )
    rated = first.credibility_rates(joined, first.overall_rate(labelled))
    return rated.select("projectid", *[rounded(n).alias(n) for n in names])


# --- assembly and roll-ups ----------------------------------------------------------------


@query
def resource_rollup(spark, folder):
    rolled = first.resource_totals(fixtures.load(spark, folder))
    return rolled.select(
        "projectid",
        *[
            rounded(c, 2).alias(c) if c.endswith("total") else F.col(c)
            for c in first.resource_columns()
        ],
    )


@query
def star_assemble(spark, folder):
    wide = first.assemble(fixtures.load(spark, folder), FIRST)
    per_entity = [
        f"{key}_{part}"
        for key in first.HISTORY_KEYS
        for part in ("days", "y_prev", "y5_prev", "cnt", "cnt_train")
    ]
    donors = [f"{key}_{y}_prev" for key in first.DONOR_KEYS for y in first.DONOR_LABELS]
    money = {c for c in [*first.resource_columns(), *donors] if c.endswith(("total", "y13_prev"))}
    names = [*first.COUNT_LABELS.values(), *per_entity, *first.resource_columns(), *donors]
    return wide.select(
        "projectid", *[rounded(c, 2).alias(c) if c in money else F.col(c) for c in names]
    )


@query
def resource_window(spark, folder):
    held = fixtures.resources(spark, folder).join(
        second_base(spark, folder).select("projectid"), "projectid", "inner"
    )
    summary = assemble.resource_summary(
        held, "projectid", F.col("item_unit_price") * F.col("item_quantity"), "item_quantity",
        "project_resource_type",
    )
    return summary.withColumn("resource_price", rounded("resource_price", 2))


@query
def top_vendor(spark, folder):
    held = fixtures.resources(spark, folder).join(
        second_base(spark, folder).select("projectid"), "projectid", "inner"
    )
    best = assemble.top_vendor(
        held, "projectid", "vendorid", F.col("item_unit_price") * F.col("item_quantity"),
        "item_quantity",
    )
    return best.withColumns(
        {
            "project_vendor_price": rounded("project_vendor_price", 2),
            "vendor_price": rounded("vendor_price", 2),
            "vendor_average_price": rounded("vendor_average_price", 4),
        }
    )


@query
def donation_counts(spark, folder):
    base = second_base(spark, folder)
    gifts = second.donation_summary(fixtures.donations(spark, folder))
    count = F.col("project_donations_cnt")
    return base.join(gifts, "projectid", "left").select(
        "projectid",
        "test",
        F.when(count.isNull() & (F.col("test") == 0), F.lit(0)).otherwise(count).alias(
            "project_donations_cnt"
        ),
        text_day("max_donation_date"),
    )


@query
def donation_cumulative(spark, folder):
    base = second_base(spark, folder)
    gifts = second.donation_summary(fixtures.donations(spark, folder))
    counted = materialize(
        base.join(gifts, "projectid", "left").select(
            "projectid", "date_posted", "teacher_acctid", "schoolid",
            F.coalesce("project_donations_cnt", F.lit(0)).alias("_n"),
        ),
        "donation-counts",
    )
    result = counted
    for key in ("teacher_acctid", "schoolid"):
        name = f"cnt_donations_{key}_cumsum"
        daily = calendar.day_profile(counted, [key], "date_posted", _n=F.sum("_n"))
        before = calendar.total_before_day(daily, key, "date_posted", "_n", name)
        result = calendar.attach_by_day(result, before, [key], "date_posted")
    return result.select(
        "projectid", "cnt_donations_teacher_acctid_cumsum", "cnt_donations_schoolid_cumsum"
    )


@query
def group_mean_back(spark, folder):
    base = stored_base(
        spark, folder, "school_city", "schoolid", PRICE, "optional_support", "school_metro"
    )
    by_city = lookup.group_mean(
        base, ["school_city"], "projectid",
        {
            "price_school_city": (PRICE, True),
            "optional_support_mean_school_city": ("optional_support", False),
        },
    )
    by_school = lookup.group_mean(
        by_city, ["schoolid"], "projectid", {"price_schoolid": (PRICE, True)}, source=base
    )
    by_metro = lookup.group_mean(
        by_school, ["school_metro"], "projectid", {"price_metro": (PRICE, False)}, source=base
    )
    names = ["price_school_city", "optional_support_mean_school_city", "price_schoolid", "price_metro"]
    return by_metro.select("projectid", *[rounded(n, 4).alias(n) for n in names])


@query
def school_intensity(spark, folder):
    base = stored_base(
        spark, folder, "date_posted", "schoolid", "last_date_posted", second.PRICE
    )
    daily = calendar.day_profile(
        base, ["schoolid"], "date_posted", _p=F.sum(second.PRICE),
        last_date_posted=F.first("last_date_posted"),
    )
    whole = second._whole("schoolid")
    total = F.coalesce(F.sum("_p").over(whole), F.lit(0.0))
    first_day = F.min("date_posted").over(whole)
    open_days = F.datediff("last_date_posted", first_day)
    profile = daily.select(
        "schoolid", "date_posted", total.alias("total"), first_day.alias("first_day"),
        open_days.alias("open_days"), F.try_divide(total, open_days).alias("per_day"),
    )
    attached = calendar.attach_by_day(
        base.select("projectid", "schoolid", "date_posted"), profile, ["schoolid"], "date_posted"
    )
    return attached.select(
        "projectid",
        rounded("total", 4).alias("i_price_ttl_schoolid"),
        F.col("first_day").cast("string").alias("min_date_posted_schoolid"),
        F.col("open_days").alias("ttl_days_schoolid"),
        rounded("per_day", 4).alias("i_price_per_day_schoolid"),
    )


@query
def global_prior(spark, folder):
    base = second_base(spark, folder)
    prior = base.filter(F.col("test") == 0).agg(F.avg("y").alias("p")).scalar()
    return base.select("projectid", rounded(prior).alias("p"), "days_since_posted")


@query
def essay_route(spark, folder):
    loaded = fixtures.load(spark, folder)
    routed = second.routed_essays(loaded, second.project_list(second.labelled(loaded, SECOND)))
    return routed.select("projectid", "split", "y", F.md5("essay").alias("essay_md5"))


# --- calendar -------------------------------------------------------------------------------

ENTITIES = {"city": "school_city", "zip": "school_zip", "schoolid": "schoolid"}


@query
def calendar_counts(spark, folder):
    base = stored_base(spark, folder, "date_posted", *ENTITIES.values())
    result = base
    for suffix, key in ENTITIES.items():
        counts = calendar.neighbour_counts(
            base, key, "date_posted",
            spans={f"cnt_wk_{suffix}": (-3, 3), f"cnt_bwk_{suffix}": (-6, 6)},
            month=f"cnt_mth_{suffix}",
        )
        result = calendar.attach_by_day(result, counts, [key], "date_posted")
    return result.drop("date_posted", *ENTITIES.values())


@query
def calendar_offsets(spark, folder):
    base = stored_base(spark, folder, "date_posted", *ENTITIES.values())
    result = base
    for suffix, key in ENTITIES.items():
        names = {
            f"cnt_day_{suffix}" + ("" if k == 0 else f"_m{-k}" if k < 0 else f"_p{k}"): k
            for k in range(-6, 7)
        }
        counts = calendar.neighbour_counts(base, key, "date_posted", offsets=names)
        result = calendar.attach_by_day(result, counts, [key], "date_posted")
    return result.drop("date_posted", *ENTITIES.values())


@query
def rolling_rate(spark, folder):
    scored = fixtures.projects(spark, folder).withColumn(
        "score", F.coalesce(F.col(PRICE), F.lit(0.0)) / 1000000
    )
    daily = calendar.trailing_rate(scored, "date_posted", "score", first.TRAILING_ROWS)
    return daily.select(
        text_day(), "day_cnt", rounded("day_sum").alias("day_sum"),
        *[rounded(n).alias(n) for n in first.TRAILING_ROWS],
    )


@query
def rolling_rate_days(spark, folder):
    scored = fixtures.projects(spark, folder).withColumn(
        "score", F.coalesce(F.col(PRICE), F.lit(0.0)) / 1000000
    )
    daily = calendar.trailing_rate_by_days(scored, "date_posted", "score", first.TRAILING_ROWS)
    return daily.select(
        text_day(), "day_cnt", rounded("day_sum").alias("day_sum"),
        *[rounded(n).alias(n) for n in first.TRAILING_ROWS],
    )


@query
def daily_pred(spark, folder):
    scored = fixtures.projects(spark, folder).withColumn("pred", F.col(PRICE) / 1000000)
    return calendar.daily_mean(scored, "date_posted", "pred", SECOND.data_end).select(
        text_day(), rounded("pred_mean").alias("pred_mean"), "days_to_end"
    )


def _curve(spark, folder):
    gifts = second.donation_summary(fixtures.donations(spark, folder))
    base = second_base(spark, folder).join(gifts, "projectid", "left")
    return base, second.funding_curve(base, SECOND)


@query
def maturity_curve(spark, folder):
    _, curve = _curve(spark, folder)
    return curve.withColumns(
        {c: rounded(c).alias(c) for c in ("is_exciting_pct", "factor")}
    )


@query
def maturity_factor(spark, folder):
    base, curve = _curve(spark, folder)
    attached = second.attach_factor(base, "days_since_posted", curve, "days_to_fully_funding")
    score = F.coalesce(F.col(PRICE), F.lit(0.0)) / 1000000
    return attached.select(
        "projectid", "days_since_posted", rounded("factor").alias("factor"),
        rounded(second.apply_factor(score, F.col("factor"))).alias("pred"),
    )


# --- target encoding ------------------------------------------------------------------------


def _encoding_rows(spark, folder):
    keys = list(dict.fromkeys(k for e in second.ENCODINGS for k in e.keys))
    base = second_base(spark, folder)
    prior = base.filter(F.col("test") == 0).agg(F.avg("y").alias("p")).scalar()
    rows = base.select("projectid", "y", "test", *keys).withColumn("p", prior)
    return materialize(rows, "encoding-rows")


@query
def target_encode(spark, folder):
    rows = _encoding_rows(spark, folder)
    plain = [replace(e, noise=None) for e in second.ENCODINGS]
    encoded = encode.target_encode_all(
        rows, "projectid", "y", "p", F.col("test") == 0, plain
    )
    return encoded.select("projectid", *[rounded(e.name).alias(e.name) for e in plain])


@query
def target_encode_parts(spark, folder):
    rows = _encoding_rows(spark, folder)
    parts = encode.target_encode(
        rows, ["school_ncesid"], "projectid", "y", "p", F.col("test") == 0, 25
    )
    return parts.select(
        "projectid", "count_x", "sum_y",
        *[rounded(c).alias(c) for c in ("avg_p", "exp_y", "adj_y")],
    )


@query
def target_encode_noise(spark, folder):
    rows = _encoding_rows(spark, folder)
    encoded = encode.target_encode_all(
        rows, "projectid", "y", "p", F.col("test") == 0, second.ENCODINGS
    )
    return encoded.select("projectid", *[rounded(e.name).alias(e.name) for e in second.ENCODINGS])


# --- scores and evaluation ------------------------------------------------------------------


@query
def oof_pick(spark, folder):
    docs = fixtures.essays(spark, folder)
    full = text.word_count(F.col("essay")) / 1000
    partial = F.when(F.col("projectid") % 10 < 7, F.when(F.col("projectid") % 11 == 0, 0.0).otherwise(full / 2))
    return docs.select(
        "projectid",
        rounded(scalars.first_scored(partial, full)).alias("essay_y_pp"),
        rounded(scalars.first_scored(partial, full, zero_is_missing=False)).alias("essay_y_pp_keep_zero"),
    )


@query
def oof_union(spark, folder):
    loaded = fixtures.load(spark, folder)
    routed = second.routed_essays(loaded, second.project_list(second.labelled(loaded, SECOND)))
    words = text.word_count(F.col("essay"))
    parts = [
        routed.filter(F.col("split") == split).select(
            "projectid", (words * factor).cast("bigint").alias("essay_tfidf")
        )
        for split, factor in (("train", 1), ("validation", 2), ("test", 3))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def final_blend(spark, folder):
    loaded = fixtures.load(spark, folder)
    day_score = (F.dayofmonth(posted()) + F.month(posted())) / 50
    singles = {
        "pred_v1": day_score, "pred_v2": day_score / 2, "pred_v4": day_score / 3,
        "pred_v5": day_score / 4, "pred_et_v4": day_score / 5,
    }
    one = loaded.projects.withColumns({**singles, **first.calendar_columns(FIRST)}).filter(
        F.col("split") == "test"
    ).withColumn("is_exciting", first.blend())
    curve = _curve(spark, folder)[1]
    score = F.coalesce(F.col(PRICE), F.lit(0.0)) / 1000000
    days = {
        "pred_day_gbm": score, "pred_day_et": score / 2, "pred_day_glmnet": score / 3,
        "pred_day_rf": score / 4,
    }
    two = second.attach_factor(
        second_base(spark, folder).filter(F.col("test") == 1), "days_since_posted", curve,
        "days_to_fully_funding",
    ).withColumns(days).withColumn(
        "is_exciting", second.apply_factor(second.blend(), F.col("factor"))
    )
    return final.final_blend(one, two).select(
        "projectid", rounded("is_exciting").alias("is_exciting")
    )


def _scored(spark, folder):
    labelled = _first_labels(spark, folder)
    return labelled.select(
        "projectid", "y",
        F.coalesce("students_reached", F.lit(-1.0)).alias("reach"),
        F.coalesce(PRICE, F.lit(0.0)).alias("price"),
        (F.coalesce(PRICE, F.lit(0.0)) / 1000000).alias("pred"),
    )


def _weight() -> Column:
    return (F.lit(1) + F.col("projectid") % 3).cast("double")


@query
def auc(spark, folder):
    scored = _scored(spark, folder).withColumn("score", F.floor(F.col("price") / 100))
    return evaluate.auc(scored, "score", "y").withColumn("auc", rounded("auc", 9))


@query
def fold_auc(spark, folder):
    scored = _scored(spark, folder).withColumn("score", F.floor(F.col("price") / 100))
    found = text_scores.fold_auc(scored, "score", "y", (F.col("projectid") % 10).cast("int"), 10)
    return found.withColumn("auc", rounded("auc", 9))


@query
def gini(spark, folder):
    scored = evaluate.gini(_scored(spark, folder), "reach", "y", _weight())
    return scored.select(*[rounded(c, 9).alias(c) for c in scored.columns])


@query
def lift_table(spark, folder):
    lifted = evaluate.lift_table(
        _scored(spark, folder), "projectid", "price", "pred", "y", 10, _weight()
    )
    exact = ("pidx", "min_a", "max_a")
    return lifted.select(
        *[F.col(c) if c in exact else rounded(c, 4).alias(c) for c in lifted.columns]
    )


@query
def log_features(spark, folder):
    base = stored_base(
        spark, folder, "date_posted", "school_city", PRICE, "students_reached"
    )
    counts = calendar.neighbour_counts(
        base, "school_city", "date_posted", spans={"cnt_wk_city": (-3, 3), "cnt_bwk_city": (-6, 6)}
    )
    df = calendar.attach_by_day(base, counts, ["school_city"], "date_posted").withColumn(
        "students_reached_v2", F.coalesce("students_reached", F.lit(-1.0))
    )
    wanted = {
        n: c for n, c in second.logs().items()
        if second.LOGS[n][0] in df.columns
    }
    zero_price = scalars.log_offset(F.col(PRICE) - F.col(PRICE)).alias("log_of_zero")
    return df.select("projectid", *[rounded(c).alias(n) for n, c in wanted.items()], zero_price)


@query
def impute_flags(spark, folder):
    base = stored_base(
        spark, folder, "date_posted", "schoolid", second.PRICE, "students_reached"
    )
    past = lookback.lag_features(
        base, "schoolid", "date_posted", "projectid", second.PRICE,
        "days_since_prev_schoolid", "i_price_prev_dif_schoolid",
    )
    df = past.join(base.select("projectid", "students_reached"), "projectid")
    constants = {
        "days_since_prev_schoolid": -1, "i_price_prev_dif_schoolid": 0, "students_reached": -1,
    }
    out = learners.impute_flags(df, constants)
    return out.select(
        "projectid",
        *[rounded(f"{c}_imp", 4).alias(f"{c}_imp") for c in constants],
        *[f"{c}_missing" for c in constants],
    )


# --- text -----------------------------------------------------------------------------------


@query
def text_clean(spark, folder):
    body = F.col("text")
    escaped = F.concat(F.lit("\\n"), F.regexp_replace(body, "\n", "\\\\t"), F.lit("\\r it's  "))
    return fixtures.source(spark, folder, "documents").select(
        "doc_id",
        text.clean_text(body).alias("clean"),
        text.clean_text(escaped, lower=True).alias("clean_escaped"),
    )


@query
def text_lengths(spark, folder):
    cleaned = {
        f"{c}_length": text.word_count(text.clean_text(F.col(c))) for c in ("title", "essay")
    }
    return second.token_counts(fixtures.essays(spark, folder), cleaned)


@query
def text_tokens(spark, folder):
    docs = fixtures.source(spark, folder, "documents")
    tokens = docs.select(
        "doc_id",
        text.rich_tokens(text.clean_text(F.col("text"))).alias("_rich"),
        text.letter_tokens(F.col("text")).alias("_letters"),
    )
    return tokens.select(
        "doc_id",
        F.size("_rich").alias("rich_cnt"),
        F.array_join("_rich", " ").alias("rich"),
        F.size("_letters").alias("letter_cnt"),
        F.array_join("_letters", " ").alias("letters"),
    )


@query
def ngrams(spark, folder):
    docs = fixtures.source(spark, folder, "documents")
    grams = text.ngrams(text.letter_tokens(F.col("text")), 4)
    return docs.select("doc_id", grams.alias("_g")).select(
        "doc_id",
        F.size("_g").alias("ngram_cnt"),
        F.size(F.array_distinct("_g")).alias("ngram_distinct"),
        F.md5(F.array_join(F.sort_array("_g"), "\n")).alias("ngram_md5"),
    )


def _counts(spark, folder, largest: int, keep=()):
    docs = fixtures.source(spark, folder, "documents").withColumn(
        "fold", scalars.even_fold(scalars.uniform_from_id(F.col("doc_id"), "text"), 5)
    )
    return docs, terms.term_counts(
        docs, "doc_id", "text", text.ngrams(text.letter_tokens(F.col("text")), largest), keep
    )


@query
def doc_freq(spark, folder):
    _, counts = _counts(spark, folder, 2)
    return terms.document_frequency(counts, 10)


@query
def doc_freq_by_fold(spark, folder):
    _, counts = _counts(spark, folder, 2, keep=["fold"])
    return terms.document_frequency_by_fold(counts, "fold", range(5), 2)


@query
def term_index(spark, folder):
    _, counts = _counts(spark, folder, 4)
    return terms.term_index(terms.document_frequency(counts, 2)).select("term", "df", "term_id")


@query
def tfidf(spark, folder):
    docs, counts = _counts(spark, folder, 2)
    stored_counts = materialize(counts, "counts")
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    weights = terms.tfidf_weights(
        stored_counts, "doc_id", terms.document_frequency(stored_counts, 2), total
    )
    return weights.withColumn("weight", rounded("weight"))


def _labelled_docs(spark, folder):
    labels_table = fixtures.source(spark, folder, "labels").select("doc_id", "quality")
    docs = fixtures.source(spark, folder, "documents").select("doc_id", "text")
    return docs.join(labels_table, "doc_id", "left")


@query
def text_score(spark, folder):
    docs = _labelled_docs(spark, folder)
    field = text_scores.TextField("text", 2, 2, 5e-6)
    return text_scores.score_fixed_vocabulary(
        docs, "doc_id", field, "quality", F.col("quality").isNotNull()
    )


@query
def text_score_oof(spark, folder):
    docs = _labelled_docs(spark, folder).withColumn(
        "split",
        F.when(F.col("quality").isNull(), "test")
        .when(scalars.even_fold(scalars.uniform_from_id(F.col("doc_id"), "val"), 5) == 0, "validation")
        .otherwise("train"),
    )
    field = text_scores.TextField("text", 4, 2, 4e-6)
    return text_scores.score_refitted_vocabulary(
        docs, "doc_id", field, "quality", "split", "text_tfidf", folds=3
    )


# --- feature tables and design rows -----------------------------------------------------------


def _plain(names: list[str], categorical: set[str]) -> list[Column]:
    """Categories as text, numbers as rounded doubles: 4 digits for money, 6 for the rest."""
    out = []
    for name in names:
        value = F.col(name)
        if name in categorical:
            out.append(value.cast("string").alias(name))
        else:
            out.append(rounded(value.cast("double"), 4 if name in oracle.MONEY else 6).alias(name))
    return out


def _features_two(spark, folder):
    """The second plan's own feature table; words / 1000 of the routed essay take the place of its text score."""
    loaded = fixtures.load(spark, folder)

    def build():
        docs = second.routed_essays(loaded, second.project_list(second.labelled(loaded, SECOND)))
        score = docs.select("projectid", (text.word_count(F.col("essay")) / 1000).alias("essay_tfidf"))
        return second.features(loaded, SECOND, second.token_counts(loaded.essays), score)

    return stored(spark, folder, "second-features-plain", build)


def _features_one(spark, folder):
    """The first plan's own feature table with trailing means of a score taken from the price.

    Words of the cleaned field take the place of its text scores: /1000 out of fold for even ids, /2000 else.
    """
    loaded = fixtures.load(spark, folder)

    def build():
        docs = loaded.essays.join(
            loaded.projects.filter(posted() >= F.lit(FIRST.history_start)).select("projectid"), "projectid"
        )
        fields = [f.column for f in FIRST.text_fields]
        words = docs.select(
            "projectid", *[text.word_count(text.clean_text(F.col(c))).alias(f"{c}_length") for c in fields]
        )
        even = F.col("projectid") % 2 == 0
        scores = words.withColumns(
            {f"{c}_y_pred_partial": F.when(even, F.col(f"{c}_length") / 1000) for c in fields}
            | {f"{c}_y_pred": F.col(f"{c}_length") / 2000 for c in fields}
        )
        derived = first.derive(first.assemble(loaded, FIRST, scores), loaded, FIRST)
        paid = loaded.projects.select(
            "projectid", "date_posted", (F.coalesce(F.col(PRICE), F.lit(0.0)) / 1000000).alias("pred_v1")
        )
        features = first.stacked_inputs(derived, materialize(paid, "daily-score"), FIRST)
        # what the feature table and the design rows name, each once
        return features.select(*dict.fromkeys(["projectid", "split", "y", *oracle.FIRST_COLUMNS, *first.MATRIX_FEATURES]))

    return stored(spark, folder, "first-features-plain", build)


@query
def second_features(spark, folder):
    return _features_two(spark, folder).select(
        "projectid", *_plain(oracle.SECOND_COLUMNS, second.CATEGORICAL)
    )


@query
def first_features(spark, folder):
    return _features_one(spark, folder).select(
        "projectid", *_plain(oracle.FIRST_COLUMNS, first.CATEGORICAL)
    )


@query
def coded_matrix(spark, folder):
    df = _features_two(spark, folder)
    codes = levels.level_codes(df, oracle.CODED)
    return levels.coded(df, "projectid", oracle.CODED, codes)


@query
def design_rows(spark, folder):
    """All 45 terms of the first plan's matrix; places as text and one sum of the values by place."""
    df, codes, places = first.design(_features_one(spark, folder))
    rows = levels.design_rows(df, "projectid", *places, codes)
    cells = F.arrays_zip("indices", "values")
    total = F.aggregate(
        cells, F.lit(0.0), lambda sum_, c: sum_ + c["values"] * (c["indices"] % 7 + 1)
    )
    return rows.select(
        "projectid", "size", F.array_join("indices", " ").alias("places"), rounded(total, 3).alias("total")
    )


# --- models ---------------------------------------------------------------------------------


@query
def design_matrix(spark, folder):
    loaded = fixtures.load(spark, folder)
    df = loaded.projects.withColumns(first.calendar_columns(FIRST)).select(
        "projectid", "split", "weekday",
        F.coalesce("students_reached", F.lit(0.0)).alias("students_reached_imp"),
        F.coalesce("teacher_prefix", F.lit("")).alias("teacher_prefix"),
        F.coalesce("resource_type", F.lit("")).alias("resource_type"),
    )
    train = df.filter(training_mask("split", include_validation=True))
    matrix, columns = learners.design_matrix(
        train, df, ["students_reached_imp"], ["teacher_prefix", "resource_type", "weekday"]
    )
    return matrix.select("projectid", *[f"x_{i}" for i in range(len(columns))])


def _first_features(spark, folder):
    loaded = fixtures.load(spark, folder)

    def build():
        scores = first.text_features(loaded, FIRST)
        return first.derive(first.assemble(loaded, FIRST, scores), loaded, FIRST)

    return stored(spark, folder, "first-features", build)


def _first_scores(spark, folder):
    df = _first_features(spark, folder)
    return stored(
        spark, folder, "first-scores",
        lambda: first.boosted_scores(df, "pred_v1", FIRST.trees(first.TREES_FIRST), FIRST),
    )


def _second_features(spark, folder):
    loaded = fixtures.load(spark, folder)

    def build():
        d = second.labelled(loaded, SECOND)
        docs = materialize(second.routed_essays(loaded, second.project_list(d)), "routed")
        return second.features(
            loaded, SECOND, second.token_counts(loaded.essays), second.scored_texts(docs, SECOND)
        )

    return stored(spark, folder, "second-features", build)


@query
def gbt_score(spark, folder):
    return _first_scores(spark, folder).select("projectid", "pred_v1")


@query
def gbt_day_score(spark, folder):
    return second.boosted_scores(_second_features(spark, folder), SECOND)


@query
def gbt_stacked(spark, folder):
    df = _first_features(spark, folder)
    stacked = materialize(
        first.stacked_inputs(df, _first_scores(spark, folder), FIRST), "stacked"
    )
    result = stacked.select("projectid", "split")
    for name, trailing in first.STACKED.items():
        scored = first.boosted_scores(
            stacked, name, FIRST.trees(first.TREES_STACKED), FIRST, (trailing,)
        )
        result = result.join(scored.select("projectid", name), "projectid")
    return result


@query
def rf_score(spark, folder):
    return second.forest_scores(_second_features(spark, folder), SECOND)


@query
def forest_reg_score(spark, folder):
    df = _first_features(spark, folder)
    stacked = first.stacked_inputs(df, _first_scores(spark, folder), FIRST)
    return first.forest_scores(stacked, FIRST)


@query
def forest_reg_day_score(spark, folder):
    return second.coarse_scores(_second_features(spark, folder), SECOND)


@query
def ridge_cv_score(spark, folder):
    return second.ridge_scores(_second_features(spark, folder), SECOND)
