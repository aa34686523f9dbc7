"""Input tables: explicit schemas, CSV and Parquet readers, sinks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: columns of the input files -------------------------------------------
PROJECTS = """
    projectid STRING, teacher_acctid STRING, schoolid STRING, school_ncesid STRING,
    school_latitude DOUBLE, school_longitude DOUBLE, school_city STRING, school_state STRING,
    school_zip STRING, school_metro STRING, school_district STRING, school_county STRING,
    teacher_prefix STRING, teacher_teach_for_america STRING, teacher_ny_teaching_fellow STRING,
    primary_focus_subject STRING, primary_focus_area STRING, secondary_focus_subject STRING,
    resource_type STRING, poverty_level STRING, grade_level STRING,
    total_price_excluding_optional_support DOUBLE,
    total_price_including_optional_support DOUBLE, students_reached DOUBLE,
    eligible_double_your_impact_match STRING, eligible_almost_home_match STRING,
    date_posted DATE
"""
OUTCOMES = """
    projectid STRING, is_exciting STRING, at_least_1_teacher_referred_donor STRING,
    fully_funded STRING, at_least_1_green_donation STRING, great_chat STRING,
    three_or_more_non_teacher_referred_donors STRING,
    one_non_teacher_referred_donor_giving_100_plus STRING,
    donation_from_thoughtful_donor STRING, teacher_referred_count DOUBLE,
    non_teacher_referred_count DOUBLE
"""
DONATIONS = """
    projectid STRING, donation_timestamp STRING, donation_total DOUBLE, is_teacher_acct STRING,
    payment_included_acct_credit STRING, payment_included_campaign_gift_card STRING,
    payment_included_web_purchased_gift_card STRING, payment_was_promo_matched STRING,
    via_giving_page STRING, for_honoree STRING
"""
RESOURCES = """
    projectid STRING, vendorid STRING, project_resource_type STRING, item_unit_price DOUBLE,
    item_quantity DOUBLE
"""
ESSAYS = """
    projectid STRING, title STRING, short_description STRING, need_statement STRING,
    essay STRING
"""
SCHOOLS = "school_ncesid STRING, school_type STRING"
# ----------------------------------------------------------------------------------------

POSITION = "load_position"


@dataclass(frozen=True)
class Tables:
    """The six logical tables both plans start from.

    ``essays`` may hold several copies per project if it has a load position (see
    ``one_essay``); without one its project ids must be unique.
    """

    projects: DataFrame
    outcomes: DataFrame
    donations: DataFrame
    resources: DataFrame
    essays: DataFrame
    schools: DataFrame


def declared(name: str) -> str:
    return {
        "projects": PROJECTS,
        "outcomes": OUTCOMES,
        "donations": DONATIONS,
        "resources": RESOURCES,
        "essays": ESSAYS,
        "schools": SCHOOLS,
    }[name]


def read_csv(
    spark: SparkSession, path: str, schema: str, multiline: bool = False, position: bool = False
) -> DataFrame:
    """CSV with a header; columns are matched to the schema by header name, in any order.

    Quotes inside quoted fields are doubled. ``multiline`` also accepts line breaks inside
    quotes; such a file cannot be split, so store large text as several files or as Parquet.
    ``position`` adds the load position (file, then row) for "first or last copy wins"; it
    needs ``multiline``, because only unsplit files keep their row order.
    """
    if position and not multiline:
        raise ValueError("a load position needs unsplit files: set multiline")
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("maxCharsPerColumn", -1)
    )
    header = reader.csv(path).columns
    wanted = spark.createDataFrame([], schema).schema
    by_name = {field.name: field for field in wanted}
    missing = [name for name in by_name if name not in header]
    if missing:
        raise ValueError(f"{path}: columns missing from the header: {missing}")
    ddl = ", ".join(
        f"`{name}` {by_name[name].dataType.simpleString() if name in by_name else 'STRING'}"
        for name in header
    )
    scanned = reader.schema(ddl).csv(path)
    if not position:
        return scanned.select(*by_name)
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("row"))
    return scanned.select(*by_name, place.alias(POSITION))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that ``read_csv`` returns unchanged, blanks and line breaks included."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_submission(df: DataFrame, path: str, columns: list[str]) -> None:
    """Final scores as CSV with a header."""
    write_csv(df.select(*columns), path)


def one_essay(essays: DataFrame, pick) -> DataFrame:
    """First or last copy per trimmed project id; ``pick`` is keep_first or keep_last."""
    if POSITION not in essays.columns:
        return essays
    return pick(essays, F.trim(F.col("projectid")), "projectid", POSITION).drop(POSITION)


def school_types(
    df: DataFrame, id_column: str = "school_ncesid", type_column: str = "School.Type"
) -> DataFrame:
    """External dimension reduced to (school_ncesid, school_type), columns named explicitly."""
    return df.select(
        F.col(f"`{id_column}`").cast("string").alias("school_ncesid"),
        F.col(f"`{type_column}`").alias("school_type"),
    )


def load_folder(
    spark: SparkSession, folder: str, file_names: dict[str, str] | None = None,
    school_id: str = "school_ncesid", school_type: str = "School.Type",
) -> Tables:
    """Read the six CSV tables of a folder. ``file_names`` overrides single names."""
    names = {field.name: f"{field.name}.csv" for field in fields(Tables)}
    names.update(file_names or {})

    def path(name: str) -> str:
        return f"{folder.rstrip('/')}/{names[name]}"

    tables = {
        name: read_csv(
            spark, path(name), declared(name), multiline=name == "essays", position=name == "essays"
        )
        for name in ("projects", "outcomes", "donations", "resources", "essays")
    }
    dimension = spark.read.option("header", True).csv(path("schools"))
    return Tables(**tables, schools=school_types(dimension, school_id, school_type))


def load_parquet(spark: SparkSession, folder: str) -> Tables:
    """Read the six tables from ``<folder>/<name>.parquet``."""
    base = folder.rstrip("/")
    return Tables(
        **{f.name: spark.read.parquet(f"{base}/{f.name}.parquet") for f in fields(Tables)}
    )


def save_parquet(tables: Tables, folder: str) -> None:
    """Store the tables once as Parquet so later runs scan only the columns they need."""
    for field in fields(Tables):
        getattr(tables, field.name).write.parquet(f"{folder.rstrip('/')}/{field.name}.parquet")
