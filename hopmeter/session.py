"""Session settings and the folder every executor can reach."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Called when the stage tables of an application go, with its id.
ON_DROP: list[Callable[[str], None]] = []
# Per thread: for each call of ``settle`` that goes on, the tables written in it.
_SCRATCH = threading.local()


def build_session(app: str = "hopmeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Zone-less timestamps become epoch milliseconds in UTC, whatever the host."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/hopmeter/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder, and forget who reads it."""
    for forget in ON_DROP:
        forget(spark.sparkContext.applicationId)
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete folders in the shared folder that nothing reads any more."""
    for folder in folders:
        _delete(spark, folder)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = path(old), path(new)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(source):
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{old} could not be renamed to {new}")


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are over stay until the driver's garbage is collected; so it is collected."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The table outlives lost executors, fixes values that depend on task layout
    (positions, partition numbers), and later reads are column pruned.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if open_calls := getattr(_SCRATCH, "calls", None):
        open_calls[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that are cut inside are deleted at the end, and the shuffle files of what ran inside."""
    calls = _SCRATCH.calls = getattr(_SCRATCH, "calls", None) or []
    calls.append([])
    try:
        yield
    finally:
        discard(spark, *calls.pop())
        forget_shuffles(spark)


def settle(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """``cut`` of what ``build()`` gives; the tables that were cut for it alone are deleted, and their shuffle files."""
    calls = _SCRATCH.calls = getattr(_SCRATCH, "calls", None) or []
    calls.append([])
    try:
        made = build()
        spent = list(calls[-1])
        out = cut(made, label)
    except BaseException:
        calls.pop()
        raise
    written = calls.pop()
    if calls:
        calls[-1].append(written[-1])
    del made
    for path in spent:
        _delete(spark, path)
    forget_shuffles(spark)
    return out
