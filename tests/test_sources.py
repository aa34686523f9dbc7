import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagwise import session
from lagwise.operators import assemble
from lagwise.plans import second
from lagwise.sources import fixtures, tables

AWKWARD = [
    ("p1", 'say ""hi"", she "said"', "line one\nline two", " padded ", "back\\slash \\n"),
    ("p2", None, "comma, inside", "\ttab", "é ß"),
    ("p1", "later copy", "x y", "z", "w"),
]


def test_essay_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, tables.ESSAYS)
    path = str(tmp_path / "essays.csv")
    tables.write_csv(df.coalesce(1), path)
    back = tables.read_csv(spark, path, tables.ESSAYS, multiline=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(AWKWARD, key=str)


def test_columns_are_matched_by_header_name(spark, tmp_path):
    path = tmp_path / "outcomes.csv"
    path.write_text("extra,great_chat,projectid\nq,t,a\nq,,b\n")
    back = tables.read_csv(spark, str(path), "projectid STRING, great_chat STRING")
    assert sorted(map(tuple, back.collect())) == [("a", "t"), ("b", None)]
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, str(path), "projectid STRING, other STRING")


def test_first_and_last_copy_by_load_position(spark, tmp_path):
    path = tmp_path / "essays.csv"
    path.write_text(
        "projectid,teacher_acctid,title,short_description,need_statement,essay\n"
        '" p1 ",t,one two,a,"b\nc",d\np2,t,x,a,b,c\np1,t,three,a,b,c\n'
    )
    essays = tables.read_csv(spark, str(path), tables.ESSAYS, multiline=True, position=True)
    first_words = {r.projectid: r.title_cnt for r in second.token_counts(essays).collect()}
    assert first_words == {"p1": 2, "p2": 1}
    last = tables.one_essay(essays, assemble.keep_last)
    assert {r.projectid: r.title for r in last.collect()} == {"p1": "three", "p2": "x"}
    with pytest.raises(ValueError, match="unsplit"):
        tables.read_csv(spark, str(path), tables.ESSAYS, position=True)


def test_folder_of_csv_files_loads_with_declared_types(spark, tmp_path, folder):
    loaded = fixtures.load(spark, folder)
    for name in ("projects", "outcomes", "donations", "resources", "essays"):
        tables.write_csv(getattr(loaded, name), str(tmp_path / f"{name}.csv"))
    (tmp_path / "schools.csv").write_text("a,b,id,School.Type\n1,2,3,1-Regular school\n")
    again = tables.load_folder(spark, str(tmp_path), school_id="id")
    assert dict(again.projects.dtypes)["date_posted"] == "date"
    assert again.projects.count() == loaded.projects.count()
    assert again.resources.count() == loaded.resources.count()
    assert [tuple(r) for r in again.schools.collect()] == [("3", "1-Regular school")]
    assert again.essays.count() == loaded.essays.count()


def test_parquet_round_trip_and_pushdown(spark, tmp_path, folder):
    loaded = fixtures.load(spark, folder)
    tables.save_parquet(loaded, str(tmp_path))
    again = tables.load_parquet(spark, str(tmp_path))
    narrow = again.projects.filter(F.col("date_posted") >= F.lit(dt.date(2000, 1, 1))).select("projectid")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_posted,2000-01-01)" in plan
    assert "ReadSchema: struct<projectid:bigint,date_posted:date>" in plan


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == configured
    stored = session.materialize(spark.range(3).toDF("id"), "probe")
    assert stored.inputFiles()[0].startswith(f"file://{configured}/lagwise/")
    assert stored.count() == 3


@pytest.mark.parametrize(
    "master,warehouse,expected",
    [
        ("yarn", None, None),
        ("yarn", "file:/driver/spark-warehouse", None),
        ("spark://host:1", "/driver/spark-warehouse", None),
        ("yarn", "hdfs://store/warehouse/", "hdfs://store/warehouse"),
        ("local[8]", "file:/driver/spark-warehouse", "file:/driver/spark-warehouse"),
        ("local[8]", None, None),
    ],
)
def test_cluster_without_shared_folder_is_refused(master, warehouse, expected):
    class Conf:
        def get(self, name, default=None):
            return warehouse if name == "spark.sql.warehouse.dir" else default

    class Fake:
        conf, sparkContext = Conf(), type("Context", (), {"master": master, "applicationId": "x"})()

    if expected:
        assert session.shared_folder(Fake()) == expected
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(Fake())


def test_a_replaced_step_leaves_no_files(spark):
    import os

    rows = spark.range(5000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id")
    first, old = session.replace_stored(rows, "step")
    second, new = session.replace_stored(first.where("k > 2"), "step", old)
    assert second.count() == 4 and not os.path.exists(old) and os.path.exists(new)
    assert spark.conf.get(session._REMOVE_SHUFFLES, None) in (None, "false")
    session.remove(spark, new)
    assert not os.path.exists(new)
