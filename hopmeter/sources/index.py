"""Stored index of a topic table: which file holds which offsets and moments.

One row per file, topic partition and time bucket, with the offsets and broker times
in it. The rows lie in ``_index`` inside the table's folder, where a read of the table
does not see them. ``extend_index`` reads positions of files that are not indexed yet and
appends their rows, so each batch of a topic is indexed once. From the index come,
without opening a data file: the files that can hold an offset (``scan_from_files``),
the end offsets, and per time bucket the end offset that base offsets start from
(``baseline_from_files``). All uses take minima and maxima, so that a file indexed twice
changes nothing.

Lists of files go through the driver, as they do whenever Spark plans a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.operators.baseline import BUCKET_MS, asked_buckets, bucket_of, offsets_within
from hopmeter.schemas import TOPIC_TABLE
from hopmeter.sources.topics import least_bounds, scan_from

INDEX = (
    "path string, topic string, partition int, bucket bigint, first_offset bigint, last_offset bigint, "
    "first_ms bigint, last_ms bigint, records bigint"
)
_FOLDER = "_index"


def _folder(spark: SparkSession, path: str):
    """(folder without its scheme, its file system, the folder) as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath(), fs, at


def _files(spark: SparkSession, path: str) -> set[str]:
    """Data files of the table, named from its folder on."""
    root, fs, at = _folder(spark, path)
    found, listed = set(), fs.listFiles(at, True)
    while listed.hasNext():
        name = listed.next().getPath().toUri().getPath().removeprefix(f"{root}/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.add(name)
    return found


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without a job that starts Python workers."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("row")).select("row.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as it is stored; no rows if there is none."""
    _, fs, at = _folder(spark, f"{path}/{_FOLDER}")
    if not fs.exists(at):
        return _none(spark, INDEX)
    return spark.read.schema(INDEX).parquet(f"{path}/{_FOLDER}")


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Some files of a topic table, named from its folder on."""
    if not files:
        return spark.createDataFrame([], TOPIC_TABLE)
    some = spark.read.schema(TOPIC_TABLE).option("basePath", path).parquet(*[f"{path}/{f}" for f in files])
    return some.select(*TOPIC_TABLE.fieldNames())


def rows_of(files: DataFrame, root: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The index rows of topic files below ``root``."""
    ms = F.unix_millis("timestamp")
    rows = files.select(F.col("_metadata.file_path").alias("uri"), "topic", "partition", "offset", ms.alias("ms"))
    found = rows.groupBy("uri", "topic", "partition", bucket_of(F.col("ms"), bucket_ms).alias("bucket")).agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("records"),
    )
    # The metadata column has the path as a URI. It becomes a name after the grouping, not for every record.
    plain = F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B")))
    name = F.substring(plain, F.instr(plain, root) + len(root), F.length(plain))
    return found.select(name.alias("path"), *found.columns[1:])


def extend_index(spark: SparkSession, path: str, bucket_ms: int = BUCKET_MS) -> int:
    """Index the files that came since the last time; gives their number. Call it after each batch.

    Only positions and times are read, no values. One call at a time per table.
    """
    known = {r["path"] for r in read_index(spark, path).select("path").distinct().collect()}
    fresh = sorted(_files(spark, path) - known)
    if fresh:
        at = spark.read.schema(TOPIC_TABLE).option("basePath", path).parquet(*[f"{path}/{f}" for f in fresh])
        rows_of(at, f"{_folder(spark, path)[0]}/", bucket_ms).write.mode("append").parquet(f"{path}/{_FOLDER}")
    return len(fresh)


def end_offsets_of_files(spark: SparkSession, path: str) -> DataFrame:
    """Next offset to be written per topic partition, from the index alone."""
    return read_index(spark, path).groupBy("topic", "partition").agg((F.max("last_offset") + 1).alias("end_offset"))


def files_from(spark: SparkSession, path: str, bounds: DataFrame) -> list[str]:
    """Files with a record at or after the ``base_offset`` of their topic partition."""
    ends = read_index(spark, path).groupBy("path", "topic", "partition").agg(F.max("last_offset").alias("last_offset"))
    held = ends.join(bounds.select("topic", "partition", "base_offset"), ["topic", "partition"])
    return sorted(r["path"] for r in held.filter("last_offset >= base_offset").select("path").distinct().collect())


def scan_from_files(spark: SparkSession, path: str, bounds: DataFrame) -> DataFrame:
    """Records at or after their topic partition's ``base_offset``, of an indexed table.

    Only files that can hold such a record are opened; of those the least bound of all
    reaches the scan and skips row groups.
    """
    files = files_from(spark, path, bounds)
    least = bounds.agg(F.min("base_offset")).first()[0]
    some = read_files(spark, path, files)
    if least is not None:
        some = some.filter(F.col("offset") >= least)
    return scan_from(some, bounds)


def baseline_from_files(
    spark: SparkSession, path: str, probes: DataFrame, topics: list[str], bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """What ``baseline_offsets`` gives, of an indexed table.

    Whole earlier time buckets come from the index; records are read from the files of
    the buckets that hold probes only. ``bucket_ms`` is the width the index was made with.
    """
    index = read_index(spark, path).filter(F.col("topic").isin(topics))
    asked = asked_buckets(probes, bucket_ms)
    held = index.select("path", "partition", "bucket").join(asked, ["partition", "bucket"], "left_semi")
    files = sorted(r["path"] for r in held.select("path").distinct().collect())
    records = read_files(spark, path, files).filter(F.col("topic").isin(topics)).select(
        "topic", "partition", "offset", F.unix_millis("timestamp").alias("ms")
    )
    ends = index.select("topic", "partition", "bucket", F.col("last_offset").alias("offset"))
    return offsets_within(ends, records, probes, topics, bucket_ms)


def bounds_from_files(
    spark: SparkSession, path: str, probes: DataFrame, topics: list[str], bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Where reading must start for these probes, per topic partition."""
    return least_bounds(baseline_from_files(spark, path, probes, topics, bucket_ms))
