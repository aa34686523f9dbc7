"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that is shuffled in parts, and the rows below which it is shuffled whole.
PARTS, SMALL_ROWS = 4, 2_000_000
#: Paths of the steps stored inside each ``settled`` that runs, the innermost last.
_STEPS: list[list[str]] = []

#: Whether Spark removes the shuffle files of a statement when it has ended.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "lagwise",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session. On a cluster leave ``master`` unset so spark-submit decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A session that names none uses its warehouse folder if that is in a store other than the local file
    system, or if the master is local. On a cluster the default warehouse is a folder of the driver's
    machine, which executors do not share, so such a session is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    scheme = warehouse.split(":", 1)[0] if warehouse and ":" in warehouse else "file"
    if not warehouse or (scheme == "file" and not spark.sparkContext.master.startswith("local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return warehouse.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used.

    Everything one application writes lies under its own id, so it can be removed as a whole
    once the application has ended.
    """
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/lagwise/{application}/{label}-{uuid.uuid4().hex}"
    if _STEPS:
        _STEPS[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    Parquet rather than an in-memory cache: it survives lost executors and later readers
    still get column pruning and filter pushdown.
    """
    return replace_stored(df, label)[0]


def settled(build: Callable[[], DataFrame], label: str, key: str | None = None, rows: int = 0) -> DataFrame:
    """Store what ``build`` makes, then remove all steps that were stored on the way to it.

    Nothing but the result may read those steps afterwards. A wide table of many ``rows`` that is joined by ``key``
    is made in twice the usual parts; twenty columns count as a row of ``part_count``.
    """
    _STEPS.append([])
    try:
        df = build()
    finally:
        steps = _STEPS.pop()
    parts = 1 if part_count(rows * len(df.columns) // 20) == 1 else 2 * PARTS
    stored, _ = store_parts((df if parts == 1 else df.filter(in_part(key, k, parts)) for k in range(parts)), label)
    for path in steps:
        remove(df.sparkSession, path)
    return stored


def quiet_write(df: DataFrame, path: str) -> None:
    """Add ``df`` to ``path`` and remove what the write shuffled, which nothing reads any more."""
    spark = df.sparkSession
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)


def part_count(rows: int) -> int:
    """Parts that a large table is shuffled in, one after another, so that disk holds the shuffle of one of them."""
    return 1 if rows < SMALL_ROWS else PARTS


def in_part(key: str, part: int, parts: int) -> Column:
    """Whether a row is in a part; all rows of a key are in the same one."""
    return F.lit(True) if parts == 1 else F.pmod(F.xxhash64(F.lit(parts), F.col(key)), F.lit(parts)) == part


def store_parts(parts: Iterable[DataFrame], label: str) -> tuple[DataFrame, str]:
    """As ``replace_stored``, for a table whose parts are written one after another."""
    path, schema = None, None
    for part in parts:
        path = path or fresh_path(part.sparkSession, label)
        quiet_write(part, path)
        spark, schema = part.sparkSession, part.schema
    return spark.read.schema(schema).parquet(path), path


def replace_stored(df: DataFrame, label: str, old: str | None = None) -> tuple[DataFrame, str]:
    """As ``materialize``, for steps of which each takes the place of the one before.

    Gives the table and its path. What the write shuffled is removed at its end, and so is ``old``, the path of
    the step it replaces, so disk holds one step at a time however many there are. A lost executor is
    made good while the write runs; afterwards nothing but the new table is read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    quiet_write(df, path)
    if old:
        remove(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored step that is read no more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def remove_stored(spark: SparkSession) -> None:
    """Remove every step this application has stored; call it once its results are written."""
    remove(spark, f"{shared_folder(spark)}/lagwise/{spark.sparkContext.applicationId}")
