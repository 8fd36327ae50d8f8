"""Places in the folder that driver and executors share.

Tables that cut lineage are written below ``spark.checkpoint.dir``. Only a local master
may leave that unset (as tests do) and gets a folder of its own; elsewhere that is an
error. A table is deleted by `forget` as soon as nothing reads it any more, and what is
left when the JVM ends is deleted by Hadoop's file system.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(found)
        _delete_at_end(spark, found)
    return found


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Ask the file system to delete `path`, which must exist by now, when the JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver ends; files are to be written below it."""
    path = f"{shared_folder(spark).rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    _delete_at_end(spark, path)
    if _OPEN:
        _OPEN[-1].append(f"{path}/rows")
    return f"{path}/rows"


#: Spark's setting by which an action deletes its shuffle files at its end; else they stay until the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions delete their shuffle files in here; the session's own setting for that holds again afterwards."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once as Parquet and read back: later jobs read only the columns they need.

    What was shuffled on the way is deleted when the write ends.
    """
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like `written`, in as many buckets by `keys` as Spark shuffles into: a join on them shuffles the other table only.

    Spark reads buckets of tables in its catalog only, so there is one while the result is being looked up.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"spark_catalog.default.lectern_{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    out._lectern_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._lectern_path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path.removesuffix("/rows"))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Paths made inside each `kept_only` that is under way, the innermost last.
_OPEN: list[list[str]] = []


def kept_only(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written; all tables that were written on the way to it are then deleted."""
    _OPEN.append([])
    try:
        out = written(make(), name)
    finally:
        made = _OPEN.pop()
    for path in made:
        if path != out._lectern_path:
            _delete(out.sparkSession, path)
    if _OPEN:
        _OPEN[-1].append(out._lectern_path)
    return out


def fresh(name: str, *taken: DataFrame) -> str:
    """`name`, with underscores added until no column of `taken` has it, however letters are cased."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` stored with a number for each row, which stays the row's own in every later scan, and that column's name."""
    row = fresh("row", df)
    return written(df.withColumn(row, F.monotonically_increasing_id()), name), row


def without_rows(stored: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The rows of a table that `numbered` gave, without their number, but for those whose number is in column row of `dropped`."""
    left = stored.join(dropped.select(F.col("row").alias(row)), row, "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in stored.columns if c != row))


#: What `remembered` has made in this process, by application, name, input and the input's state.
_MADE: dict[tuple, object] = {}


def remembered(spark: SparkSession, name: str, source: str, make):
    """What `make(path)` gave for the files at `source`; made again when they have changed or the application is another."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = [files.getFileStatus(place), *(files.listStatus(place) if files.getFileStatus(place).isDirectory() else [])]
    state = tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in status)
    key = (spark.sparkContext.applicationId, name, source, state)
    if key not in _MADE:
        _MADE[key] = make(new_path(spark, name))
    return _MADE[key]
