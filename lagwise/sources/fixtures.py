"""The generated test tables dressed up as the six logical tables.

Every row of the source tables is kept; only column names and codes change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagwise.sources.tables import Tables


_SCHEMAS: dict[str, StructType] = {}


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; its footer is read for the schema only the first time."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _tf(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 't' ELSE 'f' END"


def projects(spark: SparkSession, folder: str) -> DataFrame:
    orders = source(spark, folder, "orders")
    customer = source(spark, folder, "customer")
    nation = source(spark, folder, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.selectExpr(
        "o_orderkey AS projectid",
        "o_custkey AS teacher_acctid",
        "o_custkey % 200 AS schoolid",
        "nullif(c_nationkey, 7) AS school_ncesid",
        "c_acctbal / 1000 AS school_latitude",
        "CAST(o_custkey % 360 AS DOUBLE) - 180 AS school_longitude",
        "o_custkey % 40 AS school_city",
        "c_nationkey AS school_state",
        "o_custkey % 80 AS school_zip",
        "nullif(c_mktsegment, 'FURNITURE') AS school_metro",
        "nullif(n_regionkey, 3) AS school_district",
        "o_custkey % 20 AS school_county",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'Dr.' WHEN '2-HIGH' THEN 'Mr.'
           WHEN '3-MEDIUM' THEN 'Mrs.' WHEN '5-LOW' THEN 'Ms.' END AS teacher_prefix""",
        _tf("o_custkey % 7 = 0") + " AS teacher_teach_for_america",
        _tf("o_custkey % 11 = 0") + " AS teacher_ny_teaching_fellow",
        "o_orderpriority AS primary_focus_subject",
        "c_mktsegment AS primary_focus_area",
        "nullif(CAST(o_custkey % 7 AS STRING), '3') AS secondary_focus_subject",
        """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Books' WHEN 'BUILDING' THEN 'Other'
           WHEN 'FURNITURE' THEN 'Supplies' WHEN 'HOUSEHOLD' THEN 'Technology' END
           AS resource_type""",
        """CASE o_orderkey % 4 WHEN 1 THEN 'moderate poverty' WHEN 2 THEN 'high poverty'
           WHEN 3 THEN 'highest poverty' ELSE 'low poverty' END AS poverty_level""",
        """CASE o_orderkey % 5 WHEN 0 THEN 'Grades PreK-2' WHEN 1 THEN 'Grades 3-5'
           WHEN 2 THEN 'Grades 6-8' WHEN 3 THEN 'Grades 9-12' END AS grade_level""",
        """CASE WHEN o_orderkey % 997 <> 0 THEN o_totalprice END
           AS total_price_excluding_optional_support""",
        """CASE WHEN o_orderkey % 991 <> 0 THEN o_totalprice * CAST(1.18 AS DOUBLE) END
           AS total_price_including_optional_support""",
        """CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderkey % 30 AS DOUBLE) END
           AS students_reached""",
        _tf("o_orderkey % 2 = 0") + " AS eligible_double_your_impact_match",
        _tf("o_orderkey % 3 = 0") + " AS eligible_almost_home_match",
        "CAST(o_orderdate AS DATE) AS date_posted",
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """No row for orders of the last period, as for unlabelled projects."""
    known = source(spark, folder, "orders").filter("o_orderdate < DATE '2001-01-01'")
    return known.selectExpr(
        "o_orderkey AS projectid",
        _tf("o_orderstatus = 'F'") + " AS is_exciting",
        """CASE o_orderstatus WHEN 'P' THEN 't' WHEN 'O' THEN 'f' END
           AS at_least_1_teacher_referred_donor""",
        _tf("o_orderstatus IN ('F', 'O')") + " AS fully_funded",
        """CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 't' ELSE 'f' END
           AS at_least_1_green_donation""",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 't' WHEN '4-NOT SPECIFIED' THEN NULL
           ELSE 'f' END AS great_chat""",
        _tf("o_totalprice > 200000") + " AS three_or_more_non_teacher_referred_donors",
        _tf("o_orderpriority = '2-HIGH'") + " AS one_non_teacher_referred_donor_giving_100_plus",
        _tf("o_custkey % 5 = 0") + " AS donation_from_thoughtful_donor",
        """CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END
           AS teacher_referred_count""",
        "CAST(o_custkey % 4 AS DOUBLE) AS non_teacher_referred_count",
    )


def donations(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS projectid",
        "CAST(l_shipdate AS STRING) AS donation_timestamp",
        "CASE WHEN l_partkey % 50 <> 0 THEN l_extendedprice END AS donation_total",
        "CASE l_returnflag WHEN 'R' THEN 't' WHEN 'A' THEN 'f' END AS is_teacher_acct",
        _tf("l_linestatus = 'O'") + " AS payment_included_acct_credit",
        _tf("l_linenumber = 1") + " AS payment_included_campaign_gift_card",
        """CASE l_linenumber WHEN 2 THEN 't' WHEN 3 THEN NULL ELSE 'f' END
           AS payment_included_web_purchased_gift_card""",
        _tf("l_discount > CAST(0.05 AS DOUBLE)") + " AS payment_was_promo_matched",
        _tf("l_tax > CAST(0.04 AS DOUBLE)") + " AS via_giving_page",
        _tf("l_quantity > 25") + " AS for_honoree",
    )


def resources(spark: SparkSession, folder: str) -> DataFrame:
    lines = source(spark, folder, "lineitem")
    part = source(spark, folder, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(
        "l_orderkey AS projectid",
        "nullif(l_suppkey, 13) AS vendorid",
        """CASE p_type WHEN 'MEDIUM' THEN 'Books' WHEN 'STANDARD' THEN 'Supplies'
           WHEN 'LARGE' THEN 'Technology' WHEN 'PROMO' THEN 'Trips'
           WHEN 'SMALL' THEN 'Visitors' END AS project_resource_type""",
        "l_extendedprice / l_quantity AS item_unit_price",
        "l_quantity AS item_quantity",
    )


def essays(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "documents").selectExpr(
        "doc_id AS projectid",
        "source AS title",
        "concat(lang, ' ', source) AS short_description",
        "text AS need_statement",
        "text AS essay",
    )


def schools(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "nation").selectExpr(
        "n_nationkey AS school_ncesid",
        """CASE n_regionkey WHEN 0 THEN '1-Regular school' WHEN 1 THEN '2-Special education school'
           WHEN 2 THEN '3-Vocational school' WHEN 3 THEN '4-Alternative/other school' END
           AS school_type""",
    )


def load(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        projects=projects(spark, folder),
        outcomes=outcomes(spark, folder),
        donations=donations(spark, folder),
        resources=resources(spark, folder),
        essays=essays(spark, folder),
        schools=schools(spark, folder),
    )
