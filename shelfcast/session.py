"""Session, size-checked broadcasts and tables written to cut lineage."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it has been counted below this many rows.
BROADCAST_ROWS = 500_000
# Files of this size are small whatever their rows.
BROADCAST_BYTES = 8 << 20
ROWS_PER_BUCKET = 1_000_000

_written: dict[tuple[str, str, str], DataFrame] = {}
_own_folder: dict[str, str] = {}
_run = uuid.uuid4().hex[:8]


def build_session(cpus: int | str = "*", app: str = "shelfcast", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        # tables in the buckets of a series are joined by series and day without a shuffle
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see. Only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _own_folder:
            _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="shelfcast-")
        folder = _own_folder[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, *parts: str) -> str:
    """Path below the shared folder that belongs to this application alone."""
    app = spark.sparkContext.applicationId
    return "/".join([shared_folder(spark).rstrip("/"), f"shelfcast-{app}-{_run}", *parts])


def file_listing(spark: SparkSession, folder: str) -> str:
    """Short digest of the paths, sizes and times of all files below a folder: it changes when one of them does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha1(repr(sorted(found)).encode()).hexdigest()[:10]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what follows reads the same rows however often."""
    path = run_folder(df.sparkSession, "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Removes all that this application has written to its own folder. No table of it can be read afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    app = spark.sparkContext.applicationId
    for key in [k for k in _written if k[0] == app]:
        del _written[key]


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table counted to be small; otherwise the table as it is.

    Without the hint Spark shuffles both sides and splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows, or little enough to broadcast in any case.

    What Spark knows of the files decides where that is enough: the number of rows, or a
    size that only filters and projections can lessen. Else the rows are counted, in all
    tasks: a limit would bring the rows of all into one.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get())) <= limit
    if limit >= BROADCAST_ROWS and int(str(stats.sizeInBytes())) <= BROADCAST_BYTES:
        return True
    return df.count() <= limit


def by_day(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table with one row per calendar day.

    The calendar bounds it: a century of days is under 40,000 rows.
    """
    return F.broadcast(df)


def table(
    spark: SparkSession,
    source: str,
    name: str,
    build: Callable[[], DataFrame],
    buckets: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Write ``build()`` once per application and source, then read it back.

    With ``keys`` the table is bucketed on them, so windows, groupings and joins
    on those keys need no shuffle. Rows are kept in date order inside a bucket:
    a date filter then skips pages by their statistics.
    """
    tag = hashlib.sha1(source.encode()).hexdigest()[:10]
    memo = (spark.sparkContext.applicationId, source, name)
    if memo not in _written:
        path = run_folder(spark, tag, name)
        df = build()
        if keys:
            catalog_name = f"shelfcast_{_run}_{tag}_{name}"
            (
                df.repartition(buckets, *keys)
                .write.mode("overwrite")
                .bucketBy(buckets, *keys)
                .sortBy(*(["date"] if "date" in df.columns else keys))
                .option("path", path)
                .saveAsTable(catalog_name)
            )
            _written[memo] = spark.table(catalog_name)
        else:
            df.write.mode("overwrite").parquet(path)
            _written[memo] = spark.read.parquet(path)
    return _written[memo]


def bucket_count(spark: SparkSession, rows: int, groups: int) -> int:
    """Enough buckets for the cores and the rows, never more than keys or than Spark allows."""
    wanted = max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_BUCKET + 1)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(groups, wanted, most))
