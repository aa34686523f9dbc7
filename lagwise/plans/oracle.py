"""Independent SQL for the registered queries, written from the definitions.

Where the Spark form uses day profiles, slices or lookups, the SQL uses plain row windows,
self-joins or correlated counts, so that both cannot share a mistake.
"""

from __future__ import annotations

import re

from lagwise.plans import first, second

TIE_SHIFT = 0.123


#: Columns of the two feature tables, their money columns and the categories that get codes.
SECOND_COLUMNS = list(dict.fromkeys([
    *second.BOOSTED_FEATURES, *second.FOREST_FEATURES, *second.MATRIX_FEATURES, *second.LOG_FEATURES,
    *second.LOGS, *(f"{c}_v2" for c in second.IMPUTED), "factor",
]))
FIRST_COLUMNS = list(dict.fromkeys([*first.TREE_FEATURES, *first.MATRIX_FEATURES]))
MONEY = {
    c for c in [*SECOND_COLUMNS, *FIRST_COLUMNS]
    if not c.endswith("_ln") and ("price" in c or c.endswith(("item_amount_total", "y13_prev")) or c.startswith("optional"))
}
CODED = [
    "teacher_prefix", "resource_type", "school_type_v2", "teacher_teach_for_america", "school_metro",
    "secondary_focus_subject", "school_city", "teacher_acctid",
]


def _tf(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 't' ELSE 'f' END"


TABLES = {
    "projects": f"""
    SELECT o_orderkey AS projectid, o_custkey AS teacher_acctid, o_custkey % 200 AS schoolid,
      nullif(c_nationkey, 7) AS school_ncesid, c_acctbal / 1000 AS school_latitude,
      CAST(o_custkey % 360 AS DOUBLE) - 180 AS school_longitude, o_custkey % 40 AS school_city,
      c_nationkey AS school_state, o_custkey % 80 AS school_zip,
      nullif(c_mktsegment, 'FURNITURE') AS school_metro, nullif(n_regionkey, 3) AS school_district,
      o_custkey % 20 AS school_county,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Dr.' WHEN '2-HIGH' THEN 'Mr.'
        WHEN '3-MEDIUM' THEN 'Mrs.' WHEN '5-LOW' THEN 'Ms.' END AS teacher_prefix,
      {_tf('o_custkey % 7 = 0')} AS teacher_teach_for_america,
      {_tf('o_custkey % 11 = 0')} AS teacher_ny_teaching_fellow,
      o_orderpriority AS primary_focus_subject, c_mktsegment AS primary_focus_area,
      nullif(CAST(o_custkey % 7 AS VARCHAR), '3') AS secondary_focus_subject,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Books' WHEN 'BUILDING' THEN 'Other'
        WHEN 'FURNITURE' THEN 'Supplies' WHEN 'HOUSEHOLD' THEN 'Technology' END AS resource_type,
      CASE o_orderkey % 4 WHEN 1 THEN 'moderate poverty' WHEN 2 THEN 'high poverty'
        WHEN 3 THEN 'highest poverty' ELSE 'low poverty' END AS poverty_level,
      CASE o_orderkey % 5 WHEN 0 THEN 'Grades PreK-2' WHEN 1 THEN 'Grades 3-5'
        WHEN 2 THEN 'Grades 6-8' WHEN 3 THEN 'Grades 9-12' END AS grade_level,
      CASE WHEN o_orderkey % 997 <> 0 THEN o_totalprice END
        AS total_price_excluding_optional_support,
      CASE WHEN o_orderkey % 991 <> 0 THEN o_totalprice * CAST(1.18 AS DOUBLE) END
        AS total_price_including_optional_support,
      CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderkey % 30 AS DOUBLE) END
        AS students_reached,
      {_tf('o_orderkey % 2 = 0')} AS eligible_double_your_impact_match,
      {_tf('o_orderkey % 3 = 0')} AS eligible_almost_home_match,
      CAST(o_orderdate AS DATE) AS date_posted
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "outcomes": f"""
    SELECT o_orderkey AS projectid, {_tf("o_orderstatus = 'F'")} AS is_exciting,
      CASE o_orderstatus WHEN 'P' THEN 't' WHEN 'O' THEN 'f' END
        AS at_least_1_teacher_referred_donor,
      {_tf("o_orderstatus IN ('F', 'O')")} AS fully_funded,
      CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 't' ELSE 'f' END
        AS at_least_1_green_donation,
      CASE o_orderpriority WHEN '1-URGENT' THEN 't' WHEN '4-NOT SPECIFIED' THEN NULL
        ELSE 'f' END AS great_chat,
      {_tf('o_totalprice > 200000')} AS three_or_more_non_teacher_referred_donors,
      {_tf("o_orderpriority = '2-HIGH'")} AS one_non_teacher_referred_donor_giving_100_plus,
      {_tf('o_custkey % 5 = 0')} AS donation_from_thoughtful_donor,
      CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END
        AS teacher_referred_count,
      CAST(o_custkey % 4 AS DOUBLE) AS non_teacher_referred_count
    FROM orders WHERE o_orderdate < DATE '2001-01-01'""",
    "donations": f"""
    SELECT l_orderkey AS projectid, CAST(l_shipdate AS DATE) AS donation_date,
      CASE WHEN l_partkey % 50 <> 0 THEN l_extendedprice END AS donation_total,
      CASE l_returnflag WHEN 'R' THEN 't' WHEN 'A' THEN 'f' END AS is_teacher_acct,
      {_tf("l_linestatus = 'O'")} AS payment_included_acct_credit,
      {_tf('l_linenumber = 1')} AS payment_included_campaign_gift_card,
      CASE l_linenumber WHEN 2 THEN 't' WHEN 3 THEN NULL ELSE 'f' END
        AS payment_included_web_purchased_gift_card,
      {_tf('l_discount > CAST(0.05 AS DOUBLE)')} AS payment_was_promo_matched,
      {_tf('l_tax > CAST(0.04 AS DOUBLE)')} AS via_giving_page,
      {_tf('l_quantity > 25')} AS for_honoree
    FROM lineitem""",
    "resources": """
    SELECT l_orderkey AS projectid, nullif(l_suppkey, 13) AS vendorid,
      CASE p_type WHEN 'MEDIUM' THEN 'Books' WHEN 'STANDARD' THEN 'Supplies'
        WHEN 'LARGE' THEN 'Technology' WHEN 'PROMO' THEN 'Trips'
        WHEN 'SMALL' THEN 'Visitors' END AS project_resource_type,
      l_extendedprice / l_quantity * l_quantity AS item_price, l_quantity AS item_quantity
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "schools": """
    SELECT n_nationkey AS school_ncesid,
      CASE n_regionkey WHEN 0 THEN '1-Regular school' WHEN 1 THEN '2-Special education school'
        WHEN 2 THEN '3-Vocational school' WHEN 3 THEN '4-Alternative/other school' END
        AS school_type
    FROM nation""",
}

_FLAGS01 = ", ".join(
    f"CASE WHEN {c} = 't' THEN 1 ELSE 0 END AS {y}" for y, c in first.FLAG_LABELS.items()
)
_COUNTS01 = ", ".join(
    f"CASE WHEN {c} >= 1 THEN 1 ELSE 0 END AS {y}" for y, c in first.COUNT_LABELS.items()
)
TABLES["labelled"] = f"""
    SELECT p.*, o.* EXCLUDE (projectid), {_FLAGS01}, {_COUNTS01},
      CASE WHEN date_posted >= DATE '2001-01-01' THEN 'test'
        WHEN date_posted >= DATE '2000-01-01' THEN 'val'
        WHEN date_posted >= DATE '1995-07-01' THEN 'train' ELSE 'none' END AS history_split,
      CASE WHEN date_posted >= DATE '2001-01-01' THEN 'test'
        WHEN date_posted >= DATE '2000-06-01' THEN 'val'
        WHEN date_posted >= DATE '1995-10-01' THEN 'train' ELSE 'none' END AS training_split
    FROM projects p LEFT JOIN outcomes o ON p.projectid = o.projectid"""
TABLES["dated"] = "SELECT * FROM labelled WHERE date_posted >= DATE '1995-07-01'"
TABLES["d"] = """
    SELECT p.*, o.* EXCLUDE (projectid),
      CASE WHEN is_exciting IS NULL THEN NULL WHEN is_exciting = 't' THEN 1 ELSE 0 END AS y,
      CASE WHEN date_posted >= DATE '2001-01-01' THEN 1 ELSE 0 END AS test,
      CASE WHEN date_posted >= DATE '2000-01-01' THEN 1 ELSE 0 END AS validation,
      total_price_including_optional_support - total_price_excluding_optional_support
        AS optional_support,
      (SELECT max(date_posted) FROM projects) AS last_date_posted
    FROM projects p LEFT JOIN outcomes o ON p.projectid = o.projectid
    WHERE date_posted >= DATE '1995-07-01'"""
_KEYS7 = ", ".join(f"p.{c}" for c in first.DONOR_GROUP)
_NOT_NULL7 = " AND ".join(f"p.{c} IS NOT NULL" for c in first.DONOR_GROUP)
TABLES["donors"] = f"""
    SELECT {_KEYS7}, count(*) AS y11,
      count(*) FILTER (WHERE g.is_teacher_acct = 't') AS y12,
      sum(coalesce(g.donation_total, 0)) AS y13
    FROM projects p LEFT JOIN donations g ON p.projectid = g.projectid
    WHERE {_NOT_NULL7} GROUP BY ALL"""
TABLES["gifts"] = """
    SELECT projectid, count(*) AS n, max(donation_date) AS max_donation_date
    FROM donations GROUP BY projectid"""
TABLES["held"] = "SELECT r.* FROM resources r JOIN d ON r.projectid = d.projectid"
TABLES["prior"] = "SELECT avg(y) AS p FROM d WHERE test = 0"
TABLES["cohort"] = """
    SELECT date_diff('day', d.date_posted, g.max_donation_date) AS age, d.y
    FROM d JOIN gifts g ON d.projectid = g.projectid
    WHERE d.date_posted >= DATE '1999-01-01' AND d.date_posted < DATE '2001-01-01'
      AND d.fully_funded = 't'"""
TABLES["per_age"] = """
    SELECT age, count(*) AS n, coalesce(sum(y), 0) AS hits FROM cohort
    WHERE age BETWEEN 0 AND 120 GROUP BY age"""
TABLES["cumulated"] = """
    SELECT a.age, any_value(a.n) AS n, any_value(a.hits) AS hits, sum(b.n) AS cn,
      sum(b.hits) AS ch
    FROM per_age a JOIN per_age b ON b.age <= a.age GROUP BY a.age"""
TABLES["curve"] = """
    SELECT age, n, hits, cn, ch, ch / cn AS pct,
      (ch / cn) / (SELECT max(ch / cn) FROM cumulated) AS factor
    FROM cumulated"""
TABLES["scored"] = """
    SELECT projectid, y, coalesce(students_reached, -1) AS reach,
      coalesce(total_price_excluding_optional_support, 0) AS price,
      coalesce(total_price_excluding_optional_support, 0) / 1000000 AS pred,
      CAST(1 + projectid % 3 AS DOUBLE) AS w
    FROM labelled"""

DEPENDS = {
    "labelled": ["projects", "outcomes"], "dated": ["labelled"], "d": ["projects", "outcomes"],
    "donors": ["projects", "donations"], "gifts": ["donations"], "held": ["resources", "d"],
    "prior": ["d"], "cohort": ["d", "gifts"], "per_age": ["cohort"], "cumulated": ["per_age"],
    "curve": ["cumulated"], "scored": ["labelled"],
}


def with_tables(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the named common tables and what they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({TABLES[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def money(expression: str, name: str, digits: int = 2) -> str:
    return f"round({expression}, {digits}) AS {name}"


def history(key: str, sources: str, responses: list[str], decimals: tuple[str, ...] = ()) -> str:
    """Row-window history of one entity; rows without a key get first-row values."""
    sums = []
    for r in responses:
        value = f"coalesce(sum({r}) OVER w, 0)"
        value = f"round({value}, 2)" if r in decimals else f"CAST({value} AS BIGINT)"
        sums.append(f"CASE WHEN {key} IS NULL THEN 0 ELSE {value} END AS {key}_{r}_prev")
    return f"""
    SELECT projectid, CAST(CASE WHEN {key} IS NULL THEN 9999 ELSE coalesce(
        date_diff('day', lag(date_posted) OVER (PARTITION BY {key} ORDER BY date_posted,
        projectid), date_posted), 9999) END AS INT) AS {key}_days, {', '.join(sums)},
      CASE WHEN {key} IS NULL THEN 0 ELSE count(*) OVER w END AS {key}_cnt,
      CASE WHEN {key} IS NULL THEN 0 ELSE count(*) FILTER (WHERE date_posted < DATE '2001-01-01')
        OVER w END AS {key}_cnt_train
    FROM {sources}
    WINDOW w AS (PARTITION BY {key} ORDER BY date_posted, projectid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def entity(key: str) -> str:
    return history(key, "dated", first.LABELS)


def donor(key: str) -> str:
    return history(key, "donors", first.DONOR_LABELS, decimals=("y13",))


def uniform(value: str, salt: str) -> str:
    return (
        f"(CAST('0x' || substr(md5('{salt}:' || CAST({value} AS VARCHAR)), 1, 8) AS BIGINT)"
        " / 4294967296.0::DOUBLE)"
    )


def flag3(column: str) -> str:
    return f"CASE {column} WHEN 't' THEN 1 WHEN 'f' THEN 0 END"


def flag_null(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} = 't' THEN 1 ELSE 0 END"


def encoded(keys: tuple[str, ...], k: float, name: str, noise: float | None) -> str:
    """Leave-one-out mean from group sums; the plain join form is in target_encode_parts."""
    by_key = ", ".join(keys)
    same_s = " AND ".join(f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in keys)
    adjusted = f"(coalesce(s.sy, 0) - CASE WHEN a.test = 0 THEN a.y ELSE 0 END + p.p * {k}) / " \
               f"(coalesce(s.n, 0) - CASE WHEN a.test = 0 THEN 1 ELSE 0 END + {k})"
    value = f"coalesce({adjusted}, p.p)"
    if noise is not None:
        value += (
            f" * CASE WHEN a.test = 0 THEN 1 + ({uniform('a.projectid', name)} - 0.5) * {noise}"
            " ELSE 1 END"
        )
    return f"""
    SELECT a.projectid, round({value}, 6) AS {name}
    FROM d a CROSS JOIN prior p LEFT JOIN (
      SELECT {by_key}, count(*) AS n, sum(y) AS sy FROM d WHERE test = 0 AND y IS NOT NULL
      GROUP BY {by_key}) s ON {same_s}"""


def joined(parts: dict[str, str]) -> tuple[str, str]:
    """Common table text and a FROM clause joining the parts on projectid."""
    ctes = ", ".join(f"{n} AS ({sql})" for n, sql in parts.items())
    names = list(parts)
    clause = names[0] + "".join(f" JOIN {n} USING (projectid)" for n in names[1:])
    return ctes, clause


def each_round(sql: str, rewrite) -> str:
    """Replace every round(x, n) by ``rewrite(x, n)``."""
    out, position = [], 0
    for match in re.finditer(r"(?<![a-z_])round\(", sql):
        if match.start() < position:
            raise ValueError("nested round")
        depth, comma, end = 1, 0, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        out.append(sql[position : match.start()])
        out.append(rewrite(sql[match.end() : comma], int(sql[comma + 1 : end - 1])))
        position = end
    return "".join(out) + sql[position:]


def shift_rounding(sql: str) -> str:
    """Turn every round(x, n) into round((x) + shift, n), the rounding the queries use."""
    return each_round(sql, lambda x, n: f"round(({x}) + {TIE_SHIFT * 10.0**-n!r}, {n})")


def unrounded(sql: str) -> str:
    return each_round(sql, lambda x, n: f"({x})")


def plain(names: list[str], categorical: set[str], source: str = "f") -> str:
    """Categories as text, numbers as rounded doubles."""
    return ", ".join(
        f"CAST({source}.{n} AS VARCHAR) AS {n}" if n in categorical
        else f"round(CAST({source}.{n} AS DOUBLE), {4 if n in MONEY else 6}) AS {n}"
        for n in names
    )


def build() -> dict[str, str]:
    return {name: shift_rounding(text) for name, text in _build().items()}


def _build() -> dict[str, str]:
    sql: dict[str, str] = {}
    base = "total_price_excluding_optional_support"
    full = "total_price_including_optional_support"

    ids = [
        "projectid", "teacher_acctid", "schoolid", "school_ncesid", "school_city",
        "school_state", "school_zip", "school_district", "school_county",
    ]
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in [*ids, "date_posted"])
    sql["scan_projects"] = with_tables(f"SELECT * REPLACE ({casts}) FROM projects", "projects")
    sql["scan_essays"] = """
    SELECT CAST(doc_id AS VARCHAR) AS projectid, source AS title,
      concat(lang, ' ', source) AS short_description, text AS need_statement, text AS essay
    FROM documents"""
    sql["text_strip_nul"] = "SELECT doc_id, replace(text, 'q', '') AS text FROM documents"
    discount = "date_diff('day', date_posted, DATE '2001-08-20') * (0.5 / 131) + 0.5"
    sql["submission"] = with_tables(
        f"SELECT projectid, round(CAST({discount} AS DOUBLE), 6) AS is_exciting FROM projects "
        "WHERE date_posted >= DATE '2001-01-01'", "projects",
    )
    sql["time_discount"] = with_tables(
        f"SELECT projectid, round(CAST(0.5::DOUBLE + date_diff('day', date_posted, "
        "DATE '2001-08-20') * 0.5::DOUBLE / 131 AS DOUBLE), 6) AS discount FROM projects",
        "projects",
    )
    sql["dim_school_type"] = with_tables(
        "SELECT projectid, CAST(p.school_ncesid AS VARCHAR) AS school_ncesid, school_type "
        "FROM projects p LEFT JOIN schools s ON p.school_ncesid = s.school_ncesid",
        "projects", "schools",
    )
    for name, order in (("dedup_first", "ASC"), ("dedup_last", "DESC")):
        sql[name] = with_tables(
            f"""SELECT account, projectid, school_metro, date_posted FROM (
              SELECT CAST(teacher_acctid AS VARCHAR) AS account, projectid, school_metro,
                CAST(date_posted AS VARCHAR) AS date_posted,
                row_number() OVER (PARTITION BY teacher_acctid ORDER BY projectid {order}) AS rn
              FROM projects) WHERE rn = 1""", "projects",
        )
    sql["project_list"] = with_tables("SELECT projectid, validation, test, y FROM d", "d")
    sql["derived_prices"] = with_tables(
        f"SELECT projectid, round({full} - {base}, 4) AS optional_support, "
        f"round({base} / nullif(students_reached, 0), 6) AS price_per_student FROM projects",
        "projects",
    )
    sql["split_assign"] = with_tables(
        """SELECT projectid, history_split, training_split,
          CASE WHEN date_posted >= DATE '2000-01-01' THEN 1 ELSE 0 END AS validation,
          CASE WHEN date_posted >= DATE '2001-01-01' THEN 1 ELSE 0 END AS test
        FROM labelled""", "labelled",
    )
    sql["train_mask"] = with_tables(
        """SELECT projectid, CAST(history_split = 'train' AS INT) AS train_only,
          CAST(history_split IN ('train', 'val') AS INT) AS with_val,
          CAST(history_split IN ('train', 'val') AND y4 = 1 AND y5 = 1 AS INT) AS with_givens
        FROM labelled""", "labelled",
    )
    sql["labels"] = with_tables(
        f"SELECT projectid, {', '.join(first.LABELS)} FROM labelled", "labelled"
    )
    strict = ", ".join(f"{flag3('d.' + c)} AS {c}" for c in second.STRICT_FLAGS)
    nullable = ", ".join(f"{flag_null('d.' + c)} AS {c}" for c in second.NULLABLE_FLAGS)
    gift_sums = ", ".join(
        f"CAST(sum({flag_null(c)}) AS BIGINT) AS {c}_sum, count({c}) AS {c}_known"
        for c in second.DONATION_FLAGS
    )
    gift_names = ", ".join(f"s.{c}_sum, s.{c}_known" for c in second.DONATION_FLAGS)
    sql["labels_3v"] = with_tables(
        f"SELECT d.projectid, y, {strict}, {nullable}, {gift_names} FROM d LEFT JOIN sums s "
        "ON d.projectid = s.projectid", "d", "donations",
        extra=f"sums AS (SELECT projectid, {gift_sums} FROM donations GROUP BY projectid)",
    )

    def coded(column: str, levels: list[str], blank: str, other: str) -> str:
        whens = " ".join(f"WHEN {column} = '{v}' THEN {i + 1}" for i, v in enumerate(levels))
        return f"CASE WHEN {column} IS NULL THEN {blank} {whens} ELSE {other} END"

    sql["ordinal_encode"] = with_tables(
        f"""SELECT projectid, {coded('poverty_level', first.POVERTY_LEVELS, '0', '0')} AS poverty,
          {coded('grade_level', first.GRADE_LEVELS, '0', '0')} AS grade_level_num,
          {coded('teacher_prefix', second.TEACHER_PREFIXES, '0', 'NULL')} AS teacher_prefix_v2,
          {coded('resource_type', second.RESOURCE_LEVELS, '0', 'NULL')} AS resource_type_v2,
          coalesce(school_type, '_NA_') AS school_type_v2,
          {coded('school_type', second.SCHOOL_TYPES, '0', 'NULL')} AS school_type_v3,
          {flag3('teacher_teach_for_america')} AS teacher_teach_for_america_v2,
          {flag3('eligible_double_your_impact_match')} AS eligible_double_your_impact_match_v2,
          {flag3('eligible_almost_home_match')} AS eligible_almost_home_match_v2
        FROM projects p LEFT JOIN schools s ON p.school_ncesid = s.school_ncesid""",
        "projects", "schools",
    )
    days = "date_diff('day', DATE '1995-06-30', date_posted)"
    sql["date_parts"] = with_tables(
        f"""SELECT projectid, CAST(year(date_posted) AS INT) AS year,
          CAST(month(date_posted) AS INT) AS month, CAST(day(date_posted) AS INT) AS day,
          CAST(strftime(date_posted, '%Y%m') AS INT) AS ym, dayname(date_posted) AS weekday,
          CAST({days} AS INT) AS time,
          CASE WHEN {days} > -1 THEN round(ln({days} + 1), 6) END AS log_time,
          CAST(date_posted AS VARCHAR) AS from_timestamp
        FROM projects""", "projects",
    )
    u = uniform("projectid", "fold")
    bands = " ".join(f"WHEN u > {1 - i / 10:.1f} THEN {i}" for i in range(1, 10))
    evens = " ".join(f"WHEN u >= {i / 10:.1f} THEN {i}" for i in range(9, 0, -1))
    sql["fold_assign"] = with_tables(
        f"""SELECT projectid, round(u, 6) AS u, CASE {evens} ELSE 0 END AS even_fold,
          CASE {bands} ELSE 10 END AS descending_fold
        FROM (SELECT projectid, {u} AS u FROM projects)""", "projects",
    )

    # histories
    parts = {f"h_{k}": entity(k) for k in ("teacher_acctid", "school_district")}
    ctes, clause = joined(parts)
    sql["entity_history"] = with_tables(f"SELECT * FROM {clause}", "dated", extra=ctes)
    sql["donor_rollup"] = with_tables(
        "SELECT * REPLACE (CAST(date_posted AS VARCHAR) AS date_posted, round(y13, 2) AS y13) "
        "FROM donors", "donors",
    )
    parts = {f"h_{k}": donor(k) for k in first.DONOR_KEYS}
    ctes, clause = joined(parts)
    columns = ", ".join(f"{k}_{y}_prev" for k in first.DONOR_KEYS for y in first.DONOR_LABELS)
    sql["donor_history"] = with_tables(
        f"SELECT projectid, {columns} FROM {clause}", "donors", extra=ctes
    )
    lags = []
    for key, name in (("schoolid", "schoolid"), ("school_district", "district")):
        w = f"(PARTITION BY {key} ORDER BY date_posted, projectid)"
        lags.append(
            f"CASE WHEN {key} IS NOT NULL THEN CAST(date_diff('day', lag(date_posted) OVER {w}, "
            f"date_posted) AS INT) END AS days_since_prev_{name}, CASE WHEN {key} IS NOT NULL "
            f"THEN round({full} - lag({full}) OVER {w}, 4) END AS i_price_prev_dif_{name}"
        )
    sql["lag_features"] = with_tables(f"SELECT projectid, {', '.join(lags)} FROM d", "d")
    staggered = "lag({c}) OVER (PARTITION BY {k} ORDER BY date_posted, projectid)"
    sql["prior_extremes"] = with_tables(
        f"""SELECT projectid,
          round(nullif(max(city_prev) OVER (PARTITION BY school_city ORDER BY date_posted,
            projectid ROWS UNBOUNDED PRECEDING), -100), 4) AS i_price_school_city_cummax,
          round(nullif(min(zip_prev) OVER z, 9999999999), 4) AS i_price_school_zip_cummin,
          round(nullif(min(zip_prev) OVER z, 9999999999) - {full}, 4)
            AS i_price_dec_over_min_school_zip
        FROM shifted WINDOW z AS (PARTITION BY school_zip ORDER BY date_posted, projectid
          ROWS UNBOUNDED PRECEDING)""", "d",
        extra=f"""shifted AS (SELECT *,
          coalesce({staggered.format(c=full, k='school_city')}, -100) AS city_prev,
          coalesce({staggered.format(c=full, k='school_zip')}, 9999999999) AS zip_prev
          FROM d)""",
    )
    parts = {f"h_{k}": entity(k) for k in first.HISTORY_KEYS}
    ctes, clause = joined(parts)
    rates = ", ".join(
        f"CASE WHEN {k}_cnt = 0 THEN 0 ELSE round({k}_{y}_prev / {k}_cnt, 6) END "
        f"AS {k}_{y}_prev_rate"
        for y in first.LABELS for k in first.HISTORY_KEYS
    )
    sql["prior_rates"] = with_tables(
        f"SELECT projectid, {rates} FROM {clause}", "dated", extra=ctes
    )
    parts = {f"h_{k}": entity(k) for k in ("teacher_acctid", "schoolid")}
    ctes, clause = joined(parts)
    cred = "({k}_y_prev + 10 * m) / ({k}_cnt + 10)"
    school_rate = cred.format(k="schoolid")
    sql["credibility_rate"] = with_tables(
        f"""SELECT projectid, round(m, 6) AS pred0,
          round({cred.format(k='teacher_acctid')}, 6) AS teacher_acctid_y_prev_rate_cred,
          round({school_rate}, 6) AS schoolid_y_prev_rate_cred,
          round(least(greatest({school_rate}, 0), 0.25), 6) AS schoolid_y_prev_rate_cred_cap
        FROM {clause} CROSS JOIN (SELECT avg(y) AS m FROM dated
          WHERE training_split IN ('train', 'val'))""", "dated", extra=ctes,
    )

    # roll-ups
    def typed(alias: str, name: str, condition: str) -> str:
        return (
            f"count(*) FILTER (WHERE {condition}) AS {name}_cnt, "
            f"round(coalesce(sum(item_price) FILTER (WHERE {condition}), 0), 2) "
            f"AS {name}_item_amount_total"
        )

    types = ", ".join(
        typed("r", name, f"coalesce(project_resource_type, 'Other') = '{value}'")
        for name, value in {"agg": None, **first.RESOURCE_TYPES}.items() if value
    )
    rollup = f"SELECT projectid, {typed('r', 'agg', 'true')}, {types} FROM resources GROUP BY 1"
    sql["resource_rollup"] = with_tables(rollup, "resources")
    parts = {f"h_{k}": entity(k) for k in first.HISTORY_KEYS}
    parts |= {f"g_{k}": donor(k) for k in first.DONOR_KEYS}
    parts["r"] = rollup
    ctes = ", ".join(f"{n} AS ({s})" for n, s in parts.items())
    chosen = []
    for k in first.HISTORY_KEYS:
        chosen += [
            f"CAST(coalesce(h_{k}.{k}_{part}, 0) AS BIGINT) AS {k}_{part}"
            if part != "days" else f"coalesce(h_{k}.{k}_days, 0) AS {k}_days"
            for part in ("days", "y_prev", "y5_prev", "cnt", "cnt_train")
        ]
    for k in first.DONOR_KEYS:
        chosen += [f"g_{k}.{k}_{y}_prev" for y in first.DONOR_LABELS]
    chosen += [f"coalesce(r.{c}, 0) AS {c}" for c in first.resource_columns()]
    chosen += [f"coalesce({c}, 0) AS {c}" for c in first.COUNT_LABELS.values()]
    joins = "".join(f" LEFT JOIN {n} ON labelled.projectid = {n}.projectid" for n in parts)
    sql["star_assemble"] = with_tables(
        f"SELECT labelled.projectid, {', '.join(chosen)} FROM labelled{joins}",
        "dated", "donors", "resources", extra=ctes,
    )
    sql["resource_window"] = with_tables(
        """SELECT a.projectid, resource_cnt, resource_price, resource_quantity,
          coalesce(books_cnt, 0) AS books_cnt, books_quantity
        FROM (SELECT projectid, count(*) AS resource_cnt, round(sum(item_price), 2)
            AS resource_price, sum(item_quantity) AS resource_quantity FROM held GROUP BY 1) a
          LEFT JOIN (SELECT projectid, count(*) AS books_cnt, sum(item_quantity)
            AS books_quantity FROM held WHERE project_resource_type = 'Books' GROUP BY 1) b
          ON a.projectid = b.projectid""", "held",
    )
    sql["top_vendor"] = with_tables(
        """SELECT p.projectid, p.vendorid, round(p.price, 2) AS project_vendor_price,
          p.quantity AS project_vendor_quantity,
          (SELECT count(*) FROM pairs q WHERE q.projectid = p.projectid) AS project_vendor_cnt,
          CAST(p.price_rnk AS INT) AS project_vendor_price_rnk,
          CAST(p.quantity_rnk AS INT) AS project_vendor_quantity_rnk,
          v.n AS vendor_cnt, round(v.price, 2) AS vendor_price, v.quantity AS vendor_quantity,
          round(v.price / v.quantity, 4) AS vendor_average_price
        FROM ranked p LEFT JOIN vendors v ON p.vendorid IS NOT DISTINCT FROM v.vendorid
        WHERE p.price_rnk = 1""", "held",
        extra="""pairs AS (SELECT projectid, vendorid, sum(item_price) AS price,
            sum(item_quantity) AS quantity FROM held GROUP BY 1, 2),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY projectid
              ORDER BY price DESC, vendorid ASC NULLS FIRST) AS price_rnk,
            row_number() OVER (PARTITION BY projectid
              ORDER BY quantity DESC, vendorid ASC NULLS FIRST) AS quantity_rnk FROM pairs),
          vendors AS (SELECT vendorid, count(*) AS n, sum(item_price) AS price,
            sum(item_quantity) AS quantity FROM held GROUP BY 1)""",
    )
    sql["donation_counts"] = with_tables(
        """SELECT d.projectid, test, CASE WHEN n IS NULL AND test = 0 THEN 0 ELSE n END
            AS project_donations_cnt, CAST(max_donation_date AS VARCHAR) AS max_donation_date
        FROM d LEFT JOIN gifts g ON d.projectid = g.projectid""", "d", "gifts",
    )

    def earlier(key: str) -> str:
        return (
            f"(SELECT c.projectid, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS total FROM c LEFT JOIN c b "
            f"ON b.{key} = c.{key} AND b.date_posted < c.date_posted GROUP BY 1)"
        )

    sql["donation_cumulative"] = with_tables(
        f"""SELECT t.projectid, t.total AS cnt_donations_teacher_acctid_cumsum,
          s.total AS cnt_donations_schoolid_cumsum
        FROM {earlier('teacher_acctid')} t JOIN {earlier('schoolid')} s USING (projectid)""",
        "d", "gifts",
        extra="""c AS (SELECT d.projectid, teacher_acctid, schoolid, date_posted,
          coalesce(n, 0) AS n FROM d LEFT JOIN gifts g ON d.projectid = g.projectid)""",
    )

    def mean(column: str, key: str, is_strict: bool) -> str:
        value = f"avg({column})"
        if is_strict:
            value = f"CASE WHEN bool_or({column} IS NULL) THEN NULL ELSE {value} END"
        return f"(SELECT {key} AS k, round({value}, 4) AS m FROM d GROUP BY {key})"

    sql["group_mean_back"] = with_tables(
        f"""SELECT projectid, a.m AS price_school_city, b.m AS optional_support_mean_school_city,
          c.m AS price_schoolid, e.m AS price_metro
        FROM d LEFT JOIN {mean(base, 'school_city', True)} a ON a.k = school_city
          LEFT JOIN {mean('optional_support', 'school_city', False)} b ON b.k = school_city
          LEFT JOIN {mean(base, 'schoolid', True)} c ON c.k = schoolid
          LEFT JOIN {mean(base, 'school_metro', False)} e
            ON e.k IS NOT DISTINCT FROM school_metro""", "d",
    )
    sql["school_intensity"] = with_tables(
        f"""SELECT projectid, round(total, 4) AS i_price_ttl_schoolid,
          CAST(start AS VARCHAR) AS min_date_posted_schoolid,
          CAST(date_diff('day', start, last_date_posted) AS INT) AS ttl_days_schoolid,
          round(total / nullif(date_diff('day', start, last_date_posted), 0), 4)
            AS i_price_per_day_schoolid
        FROM d JOIN (SELECT schoolid, sum({full}) AS total, min(date_posted) AS start
          FROM d GROUP BY 1) USING (schoolid)""", "d",
    )
    sql["global_prior"] = with_tables(
        "SELECT projectid, round(p, 6) AS p, CAST(date_diff('day', date_posted, "
        "last_date_posted) AS INT) AS days_since_posted FROM d CROSS JOIN prior", "d", "prior",
    )
    routed = """routed AS (SELECT d.projectid, y, text AS essay, CASE WHEN validation = 0
        THEN 'train' WHEN test = 0 THEN 'validation' ELSE 'test' END AS split
      FROM documents JOIN d ON doc_id = projectid)"""
    sql["essay_route"] = with_tables(
        "SELECT projectid, split, y, md5(essay) AS essay_md5 FROM routed", "d", extra=routed
    )
    words = "len([x FOR x IN regexp_split_to_array({c}, '\\s+') IF x <> ''])"
    sql["oof_union"] = with_tables(
        f"""SELECT projectid, CAST({words.format(c='essay')} * CASE split WHEN 'train' THEN 1
          WHEN 'validation' THEN 2 ELSE 3 END AS BIGINT) AS essay_tfidf FROM routed""",
        "d", extra=routed,
    )

    # calendar
    suffixes = {"city": "school_city", "zip": "school_zip", "schoolid": "schoolid"}

    def near(key: str, reach: int) -> str:
        return (
            f"(SELECT a.projectid, count(*) AS n FROM d a JOIN d b ON a.{key} = b.{key} AND "
            f"abs(date_diff('day', a.date_posted, b.date_posted)) <= {reach} GROUP BY 1)"
        )

    def month(key: str) -> str:
        return (
            f"(SELECT a.projectid, count(*) AS n FROM d a JOIN d b ON a.{key} = b.{key} AND "
            "date_trunc('month', a.date_posted) = date_trunc('month', b.date_posted) GROUP BY 1)"
        )

    picks, sources = [], "d"
    for suffix, key in suffixes.items():
        for name, source in (("wk", near(key, 3)), ("bwk", near(key, 6)), ("mth", month(key))):
            picks.append(f"{name}_{suffix}.n AS cnt_{name}_{suffix}")
            sources += f" JOIN {source} {name}_{suffix} USING (projectid)"
    sql["calendar_counts"] = with_tables(f"SELECT projectid, {', '.join(picks)} FROM {sources}", "d")
    daily, picks, sources = [], [], "d"
    for suffix, key in suffixes.items():
        daily.append(
            f"day_{suffix} AS (SELECT {key} AS k, date_posted AS t, count(*) AS n FROM d "
            "GROUP BY 1, 2)"
        )
        for k in range(-6, 7):
            tag = "" if k == 0 else f"_m{-k}" if k < 0 else f"_p{k}"
            picks.append(f"coalesce({suffix}{tag}.n, 0) AS cnt_day_{suffix}{tag}")
            sources += (
                f" LEFT JOIN day_{suffix} {suffix}{tag} ON {suffix}{tag}.k = d.{key} AND "
                f"{suffix}{tag}.t = d.date_posted + {k}"
            )
    sql["calendar_offsets"] = with_tables(
        f"SELECT d.projectid, {', '.join(picks)} FROM {sources}", "d", extra=", ".join(daily)
    )
    score_days = """days AS (SELECT date_posted, count(*) AS day_cnt, sum(coalesce(
        total_price_excluding_optional_support, 0) / 1000000) AS day_sum
      FROM projects GROUP BY 1)"""
    frames = first.TRAILING_ROWS
    # a window over a window is not allowed, so the trailing means get their own step
    steps = ", ".join(
        f"CASE WHEN count(*) OVER f{n} = {n} THEN sum(day_sum) OVER f{n} / sum(day_cnt) OVER "
        f"f{n} END AS t{n}" for n in frames.values()
    )
    windows = ", ".join(
        f"f{n} AS (ORDER BY date_posted ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in frames.values()
    )
    lagged = ", ".join(
        f"round(lag(t{n}) OVER (ORDER BY date_posted), 6) AS {name}" for name, n in frames.items()
    )
    sql["rolling_rate"] = with_tables(
        f"SELECT CAST(date_posted AS VARCHAR) AS date_posted, day_cnt, round(day_sum, 6) "
        f"AS day_sum, {lagged} FROM framed", "projects",
        extra=f"{score_days}, framed AS (SELECT *, {steps} FROM days WINDOW {windows})",
    )
    ranges = "".join(
        f""" LEFT JOIN (SELECT a.date_posted, sum(b.day_sum) / sum(b.day_cnt) AS m FROM days a
          JOIN days b ON b.date_posted BETWEEN a.date_posted - {n} AND a.date_posted - 1
          GROUP BY 1) r{n} ON r{n}.date_posted = days.date_posted"""
        for n in frames.values()
    )
    picked = ", ".join(f"round(r{n}.m, 6) AS {name}" for name, n in frames.items())
    sql["rolling_rate_days"] = with_tables(
        f"SELECT CAST(days.date_posted AS VARCHAR) AS date_posted, day_cnt, round(day_sum, 6) "
        f"AS day_sum, {picked} FROM days{ranges}", "projects", extra=score_days,
    )
    sql["daily_pred"] = with_tables(
        f"""SELECT CAST(date_posted AS VARCHAR) AS date_posted, CASE WHEN bool_or({base} IS NULL)
          THEN NULL ELSE round(avg({base} / 1000000), 6) END AS pred_mean,
          CAST(date_diff('day', date_posted, DATE '2001-08-20') AS INT) AS days_to_end
        FROM projects GROUP BY date_posted""", "projects",
    )
    sql["maturity_curve"] = with_tables(
        """SELECT CAST(age AS INT) AS days_to_fully_funding, n AS project_cnt,
          CAST(hits AS BIGINT) AS is_exciting_cnt, CAST(cn AS BIGINT) AS project_cnt_cumsum,
          CAST(ch AS BIGINT) AS is_exciting_cnt_cumsum, round(pct, 6) AS is_exciting_pct,
          round(factor, 6) AS factor FROM curve""", "curve",
    )
    sql["maturity_factor"] = with_tables(
        f"""SELECT projectid, CAST(date_diff('day', date_posted, last_date_posted) AS INT)
            AS days_since_posted, round(factor, 6) AS factor,
          round(coalesce({base}, 0) / 1000000 * coalesce(factor, 1), 6) AS pred
        FROM d LEFT JOIN curve ON age = date_diff('day', date_posted, last_date_posted)""",
        "d", "curve",
    )

    # encodings
    for name, noisy in (("target_encode", False), ("target_encode_noise", True)):
        parts = {
            f"e{i}": encoded(e.keys, e.k, e.name, e.noise if noisy else None)
            for i, e in enumerate(second.ENCODINGS)
        }
        ctes, clause = joined(parts)
        sql[name] = with_tables(f"SELECT * FROM {clause}", "d", "prior", extra=ctes)
    sql["target_encode_parts"] = with_tables(
        """SELECT projectid, count_x, sum_y, round(avg_p, 6) AS avg_p,
          round(coalesce(sum_y / nullif(count_x, 0), p), 6) AS exp_y,
          round(coalesce((sum_y + 25 * p) / (count_x + 25), p), 6) AS adj_y
        FROM (SELECT a.projectid, any_value(p.p) AS p, count(b.y) AS count_x,
            CAST(coalesce(sum(b.y), 0) AS BIGINT) AS sum_y,
            CASE WHEN any_value(s.n) IS NULL THEN 0 ELSE any_value(p.p) END AS avg_p
          FROM d a CROSS JOIN prior p
          LEFT JOIN d b ON a.school_ncesid IS NOT DISTINCT FROM b.school_ncesid
            AND b.test = 0 AND b.projectid <> a.projectid
          LEFT JOIN (SELECT school_ncesid, count(*) AS n FROM d WHERE test = 0 GROUP BY 1) s
            ON a.school_ncesid IS NOT DISTINCT FROM s.school_ncesid
          GROUP BY a.projectid)""", "d", "prior",
    )

    # scores
    full_score = words.format(c="text") + " / 1000"
    sql["oof_pick"] = f"""
    SELECT doc_id AS projectid,
      round(CASE WHEN doc_id % 10 >= 7 OR doc_id % 11 = 0 OR f = 0 THEN f ELSE f / 2 END, 6)
        AS essay_y_pp,
      round(CASE WHEN doc_id % 10 >= 7 THEN f WHEN doc_id % 11 = 0 THEN 0 ELSE f / 2 END, 6)
        AS essay_y_pp_keep_zero
    FROM (SELECT doc_id, {full_score} AS f FROM documents)"""
    day_score = "(day(date_posted) + month(date_posted)) / 50"
    blend_one = f"({day_score}) * (0.1 + 0.1 / 2 + 0.45 / 3 + 0.1 / 4 + 0.25 / 5)"
    blend_two = f"coalesce({base}, 0) / 1000000 * (1 + 1 / 2 + 0.2 / 4) / 2.2"
    sql["final_blend"] = with_tables(
        f"""SELECT projectid, round((0.5 * {blend_one} + 0.5 * {blend_two} * coalesce(factor, 1))
          * ({discount}), 6) AS is_exciting
        FROM d LEFT JOIN curve ON age = date_diff('day', date_posted, last_date_posted)
        WHERE test = 1""", "d", "curve",
    )
    sql["auc"] = with_tables(
        """SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
          round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc
        FROM (SELECT a.s, a.pos, a.neg, coalesce((SELECT sum(b.neg) FROM g b WHERE b.s < a.s), 0)
          AS below FROM g a)""", "scored",
        extra="""g AS (SELECT floor(price / 100) AS s, count(*) FILTER (WHERE y = 1) AS pos,
          count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY 1)""",
    )

    sql["fold_auc"] = with_tables(
        """SELECT fold, part, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
          round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auc
        FROM (SELECT a.*, coalesce((SELECT sum(b.neg) FROM g b
            WHERE b.fold = a.fold AND b.part = a.part AND b.s < a.s), 0) AS below FROM g a)
        GROUP BY fold, part""", "scored",
        extra="""g AS (SELECT CAST(n AS INTEGER) AS fold, CASE WHEN projectid % 10 = n THEN 'test' ELSE 'train' END AS part,
          floor(price / 100) AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
          FROM scored, range(10) t(n) GROUP BY ALL)""",
    )

    def one_gini(order: str) -> str:
        both = " + ".join(
            f"(SELECT sum(cy * w) FROM (SELECT w, sum(w * y) OVER (ORDER BY {order}, projectid "
            f"{direction} ROWS UNBOUNDED PRECEDING) AS cy FROM scored)) / 2"
            for direction in ("ASC", "DESC")
        )
        return f"1 - 2 * ({both}) / (SELECT sum(w * y) * sum(w) FROM scored)"

    sql["gini"] = with_tables(
        "SELECT round(g, 9) AS gini, round(m, 9) AS max_gini, round(g / m, 9) AS normalized_gini "
        f"FROM (SELECT {one_gini('reach')} AS g, {one_gini('y')} AS m)", "scored",
    )
    names = {
        "w": "sum(w)", "min": "min(price)", "max": "max(price)", "o": "sum(price * w) / sum(w)",
        "p": "sum(pred * w) / sum(w)", "a": "sum(y * w) / sum(w)", "a_cnt": "sum(y * w)",
        "err": "(sum(y * w) / sum(w)) / (sum(pred * w) / sum(w))",
    }
    rounded = ", ".join(f"round({e}, 4) AS {n}" for n, e in names.items())
    sql["lift_table"] = with_tables(
        f"SELECT CAST(bin AS INT) AS pidx, {rounded}, min(y) AS min_a, max(y) AS max_a FROM "
        "binned GROUP BY bin", "scored",
        extra="""binned AS (SELECT *, least(greatest(round_even(sum(w) OVER (ORDER BY price,
          projectid ROWS UNBOUNDED PRECEDING) * 10 / (SELECT sum(w) FROM scored) + 0.5, 0), 1),
          10) AS bin FROM scored)""",
    )

    def ln(value: str, name: str) -> str:
        return f"CASE WHEN {value} > 0 THEN round(ln({value}), 6) END AS {name}"

    sql["log_features"] = with_tables(
        f"""SELECT projectid, {ln('coalesce(students_reached, -1) + 2', 'students_reached_v2_ln')},
          {ln(base, 'total_price_excluding_optional_support_ln')},
          {ln('b.n', 'cnt_bwk_city_ln')}, {ln('w.n', 'cnt_wk_city_ln')},
          {ln('w.n', 'cnt_mth_city_ln')}, CAST(NULL AS DOUBLE) AS log_of_zero
        FROM d JOIN {near('school_city', 3)} w USING (projectid)
          JOIN {near('school_city', 6)} b USING (projectid)""", "d",
    )
    w = "(PARTITION BY schoolid ORDER BY date_posted, projectid)"
    sql["impute_flags"] = with_tables(
        f"""SELECT projectid, CAST(coalesce(gap, -1) AS DOUBLE) AS days_since_prev_schoolid_imp,
          round(coalesce(diff, 0), 4) AS i_price_prev_dif_schoolid_imp,
          coalesce(students_reached, -1) AS students_reached_imp,
          CAST(gap IS NULL AS INT) AS days_since_prev_schoolid_missing,
          CAST(diff IS NULL AS INT) AS i_price_prev_dif_schoolid_missing,
          CAST(students_reached IS NULL AS INT) AS students_reached_missing
        FROM (SELECT projectid, students_reached, date_diff('day', lag(date_posted) OVER {w},
          date_posted) AS gap, {full} - lag({full}) OVER {w} AS diff FROM d)""", "d",
    )

    # text
    def clean(value: str) -> str:
        """The three escapes, then unwanted characters, then blanks: one step at a time."""
        for escape in ("\\\\t", "\\\\n", "\\\\r", "[^A-Za-z0-9'']"):
            value = f"regexp_replace({value}, '{escape}', ' ', 'g')"
        return f"trim(regexp_replace({value}, '\\s{{2,}}', ' ', 'g'))"

    dirty = "'\\n' || replace(text, chr(10), '\\t') || '\\r it''s  '"
    sql["text_clean"] = f"""
    SELECT doc_id, {clean('text')} AS clean, lower({clean(dirty)}) AS clean_escaped
    FROM documents"""
    counted = {
        "title_cnt": "source", "short_description_cnt": "concat(lang, ' ', source)",
        "need_statement_cnt": "text", "essay_cnt": "text", "title_length": clean("source"),
        "essay_length": clean("text"),
    }
    lengths = ", ".join(f"CAST({words.format(c=c)} AS INT) AS {n}" for n, c in counted.items())
    sql["text_lengths"] = f"SELECT doc_id AS projectid, {lengths} FROM documents"
    letters = "regexp_extract_all(lower(strip_accents(text)), '[a-zA-Z]+')"
    rich = (
        f"regexp_extract_all(lower({clean('text')}), "
        "'\\b[A-Za-z0-9()''\\-?!\"%]+\\b')"
    )
    sql["text_tokens"] = f"""
    SELECT doc_id, CAST(len(r) AS INT) AS rich_cnt, array_to_string(r, ' ') AS rich,
      CAST(len(l) AS INT) AS letter_cnt, array_to_string(l, ' ') AS letters
    FROM (SELECT doc_id, {rich} AS r, {letters} AS l FROM documents)"""
    tokens = f"""tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i
      FROM (SELECT doc_id, {letters} AS t FROM documents))"""

    def grams(largest: int) -> str:
        """N-grams as slices of the list of letter tokens, one size after another."""
        levels = [
            f"SELECT doc_id, unnest([array_to_string(t[i : i + {n - 1}], ' ') FOR i IN range(1, len(t) - {n - 2})]) AS term FROM listed_tokens"
            for n in range(1, largest + 1)
        ]
        return f"listed_tokens AS (SELECT doc_id, {letters} AS t FROM documents), grams AS ({' UNION ALL '.join(levels)})"

    sql["ngrams"] = f"""
    WITH {tokens}, {grams(4)}, listed AS (SELECT doc_id, count(*) AS n,
      count(DISTINCT term) AS u, md5(string_agg(term, chr(10) ORDER BY term)) AS h
      FROM grams GROUP BY 1)
    SELECT documents.doc_id, CAST(coalesce(n, 0) AS INT) AS ngram_cnt,
      CAST(coalesce(u, 0) AS INT) AS ngram_distinct, coalesce(h, md5('')) AS ngram_md5
    FROM documents LEFT JOIN listed ON documents.doc_id = listed.doc_id"""
    sql["doc_freq"] = f"""
    WITH {tokens}, {grams(2)}
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf_total
    FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10"""
    fold = f"CAST(floor({uniform('doc_id', 'text')} * 5) AS INT)"
    sql["doc_freq_by_fold"] = f"""
    WITH {tokens}, {grams(2)}, placed AS (SELECT DISTINCT doc_id, term, {fold} AS f FROM grams)
    SELECT CAST(fold AS INT) AS fold, term, count(*) AS df
    FROM placed JOIN (SELECT unnest(range(5)) AS fold) ON f <> fold
    GROUP BY 1, 2 HAVING count(*) >= 2"""
    sql["term_index"] = f"""
    WITH {tokens}, {grams(4)}, known AS (
      SELECT term, count(DISTINCT doc_id) AS df FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 2)
    SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM known"""
    sql["tfidf"] = f"""
    WITH {tokens}, {grams(2)}, counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
      idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
        FROM counts GROUP BY 1 HAVING count(*) >= 2),
      raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN idf USING (term)),
      norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1)
    SELECT doc_id, term, round(w / norm, 6) AS weight FROM raw JOIN norms USING (doc_id)"""

    # design matrix: intercept, numeric column, then every level but the first
    levels = (
        [("teacher_prefix", v) for v in ("Dr.", "Mr.", "Mrs.", "Ms.")]
        + [("resource_type", v) for v in ("Books", "Other", "Supplies", "Technology")]
        + [("weekday", v) for v in ("Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday")]
    )
    hot = ", ".join(
        f"CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS x_{i + 2}"
        for i, (c, v) in enumerate(levels)
    )
    sql["design_matrix"] = with_tables(
        f"""SELECT projectid, CAST(1 AS DOUBLE) AS x_0, coalesce(students_reached, 0) AS x_1, {hot}
        FROM (SELECT *, dayname(date_posted) AS weekday FROM projects)""", "projects",
    )

    # second feature table: the single queries' SQL side by side, then imputed values and logs
    parts = {
        name: f"({unrounded(sql[name])})" for name in (
            "ordinal_encode", "target_encode_noise", "calendar_counts", "lag_features", "prior_extremes",
            "group_mean_back", "school_intensity", "donation_cumulative", "resource_window", "text_lengths",
            "maturity_factor", "oof_union",
        )
    }
    own = {
        "days_since_prev_school_city": "date_diff('day', lag(d.date_posted) OVER (PARTITION BY d.school_city "
        "ORDER BY d.date_posted, d.projectid), d.date_posted)",
        "essay_tfidf": f"(SELECT {words.format(c='text')} / 1000 FROM documents WHERE doc_id = d.projectid)",
        "school_type": "(SELECT s.school_type FROM schools s WHERE s.school_ncesid = d.school_ncesid)",
    }
    taken = {
        "ordinal_encode": ["teacher_prefix_v2", "resource_type_v2", "school_type_v2", "school_type_v3",
                           "teacher_teach_for_america_v2", "eligible_double_your_impact_match_v2",
                           "eligible_almost_home_match_v2"],
        "target_encode_noise": [e.name for e in second.ENCODINGS],
        "calendar_counts": [f"cnt_{n}_{k}" for n in ("wk", "bwk", "mth") for k in suffixes],
        "lag_features": ["days_since_prev_schoolid", "i_price_prev_dif_schoolid"],
        "prior_extremes": ["i_price_school_city_cummax", "i_price_dec_over_min_school_zip"],
        "group_mean_back": ["price_school_city", "optional_support_mean_school_city", "price_schoolid"],
        "school_intensity": ["i_price_per_day_schoolid"],
        "donation_cumulative": ["cnt_donations_teacher_acctid_cumsum", "cnt_donations_schoolid_cumsum"],
        "resource_window": ["books_cnt"],
        "text_lengths": ["title_cnt", "essay_cnt"],
        "maturity_factor": ["factor"],
    }
    columns = [f"{name}.{c}" for name, cs in taken.items() for c in cs]
    columns += [f"{expression} AS {name}" for name, expression in own.items()]
    joins = "".join(f" LEFT JOIN {parts[n]} {n} ON {n}.projectid = d.projectid" for n in taken)
    table_two = f"two AS (SELECT d.*, {', '.join(columns)} FROM d{joins})"
    filled = ", ".join(
        f"coalesce({c}, {v}) AS {c}_v2" for c, v in second.IMPUTED.items()
    )
    table_two += f", imputed AS (SELECT *, {filled} FROM two), f AS (SELECT *, " + ", ".join(
        f"CASE WHEN {c} + {o} > 0 THEN ln({c} + {o}) END AS {name}" for name, (c, o) in second.LOGS.items()
    ) + " FROM imputed)"
    sql["second_features"] = with_tables(
        f"SELECT projectid, {plain(SECOND_COLUMNS, second.CATEGORICAL)} FROM f", "d", "schools", extra=table_two
    )
    ranks = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN (SELECT count(DISTINCT CAST(g.{c} AS VARCHAR)) FROM g "
        f"WHERE CAST(g.{c} AS VARCHAR) <= v.{c}) END AS {c}_code" for c in CODED
    )
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CODED)
    sql["coded_matrix"] = with_tables(
        f"SELECT projectid, {ranks} FROM v", "d", "schools",
        extra=f"""g AS (SELECT d.*, coalesce(school_type, '_NA_') AS school_type_v2 FROM d
            LEFT JOIN schools s ON d.school_ncesid = s.school_ncesid),
          v AS (SELECT projectid, {texts} FROM g)""",
    )

    # first feature table and its design rows
    length = {"title": clean("source"), "essay": clean("text")}
    lengths = ", ".join(f"{words.format(c=c)} AS {n}_length" for n, c in length.items())
    given = ", ".join(
        f"coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif({n}_length / 1000, 0) END, {n}_length / 2000) AS {n}_y_pp"
        for n in length
    )
    read = f"""SELECT doc_id AS projectid, *, {given} FROM (SELECT doc_id, {lengths} FROM documents
      WHERE doc_id IN (SELECT projectid FROM dated))"""
    rates = [c for c in FIRST_COLUMNS if c.endswith("_prev_rate")]
    shrunk = ["teacher_acctid_y_prev_rate_cred", "schoolid_y_prev_rate_cred_cap"]
    wide = [
        c for c in FIRST_COLUMNS
        if c in first.resource_columns() or c.endswith(("_days", "_cnt", "y11_prev", "y12_prev", "y13_prev"))
    ]
    trail = """SELECT date_posted, lag(CASE WHEN n = 14 THEN s / c END) OVER (ORDER BY date_posted)
        AS avg_biweekly_pred_v1 FROM (SELECT date_posted, count(*) OVER w AS n, sum(day_sum) OVER w AS s,
          sum(day_cnt) OVER w AS c FROM days WHERE date_posted >= DATE '1995-09-01'
          WINDOW w AS (ORDER BY date_posted ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""
    mine = [f"star.{c}" for c in dict.fromkeys(wide)]
    mine += [f"coalesce(rate.{c}, 0) AS {c}" for c in rates]
    overall = "(SELECT avg(y) FROM labelled WHERE training_split IN ('train', 'val'))"
    mine += [f"coalesce(cred.{shrunk[0]}, {overall}) AS {shrunk[0]}"]
    mine += [f"coalesce(cred.{shrunk[1]}, least({overall}, 0.25)) AS {shrunk[1]}"]
    table_one = f"""{score_days}, one AS (SELECT p.*, {', '.join(mine)}, dayname(p.date_posted) AS weekday,
        coalesce(students_reached, 0) AS students_reached_imp,
        coalesce({base} / nullif(students_reached, 0), 0) AS price_per_student_imp,
        read.* EXCLUDE (projectid, doc_id), trail.avg_biweekly_pred_v1
      FROM labelled p LEFT JOIN ({unrounded(sql['star_assemble'])}) star ON star.projectid = p.projectid
        LEFT JOIN ({unrounded(sql['prior_rates'])}) rate ON rate.projectid = p.projectid
        LEFT JOIN ({unrounded(sql['credibility_rate'])}) cred ON cred.projectid = p.projectid
        LEFT JOIN ({read}) read ON read.projectid = p.projectid
        LEFT JOIN ({trail}) trail ON trail.date_posted = p.date_posted)"""
    sql["first_features"] = with_tables(
        f"SELECT projectid, {plain(FIRST_COLUMNS, first.CATEGORICAL, 'one')} FROM one", "dated", extra=table_one
    )
    cells = ", ".join(
        f"""{{'i': {i}, 'level': {f"coalesce({t}, '')" if t in first.CATEGORICAL else 'NULL'},
          'value': {'1' if t in first.CATEGORICAL else f'coalesce(CAST({t} AS DOUBLE), -1)'}}}"""
        for i, t in enumerate(first.MATRIX_FEATURES)
    )
    sql["design_rows"] = with_tables(
        """SELECT projectid, (SELECT 1 + CAST(sum(n) AS INT) FROM width) AS size,
          string_agg(place, ' ' ORDER BY place) AS places, round(sum(value * (place % 7 + 1)), 3) AS total
        FROM (SELECT projectid, 0 AS place, CAST(1 AS DOUBLE) AS value FROM one UNION ALL
          SELECT projectid, start + coalesce(code - 2, 0), value FROM long JOIN starts USING (i)
            LEFT JOIN code USING (i, level)
          WHERE value <> 0 AND (long.level IS NULL OR code > 1)) GROUP BY 1""",
        "dated",
        extra=f"""{table_one},
          long AS (SELECT projectid, training_split, c.i AS i, c.level AS level, CAST(c.value AS DOUBLE) AS value
            FROM (SELECT projectid, training_split, unnest([{cells}]) AS c FROM one)),
          code AS (SELECT i, level, row_number() OVER (PARTITION BY i ORDER BY level) AS code FROM (
            SELECT DISTINCT i, level FROM long WHERE level IS NOT NULL AND training_split IN ('train', 'val'))),
          width AS (SELECT i, CASE WHEN bool_or(level IS NOT NULL) THEN
            (SELECT count(*) - 1 FROM code WHERE code.i = long.i) ELSE 1 END AS n FROM long GROUP BY i),
          starts AS (SELECT a.i, 1 + CAST(coalesce(sum(b.n), 0) AS INT) AS start
            FROM width a LEFT JOIN width b ON b.i < a.i GROUP BY a.i)""",
    )
    return sql
