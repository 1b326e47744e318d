"""Records kept in buckets of their key, so that later batches of probes meet them without a shuffle.

``first_match`` shuffles records and marks of every batch. Here the records are written once,
bucketed by the match key and in the form the matching reads; each batch of marks is
written in the same buckets, and the two meet bucket by bucket. Keys beyond the limit
for a group (``skew.split_hot``) lie in a table of their own and take the ways for hot keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopmeter.operators.first_match import BUCKET_OFFSETS, KEY, first_match
from hopmeter.operators.skew import hot_slots, slot
from hopmeter.session import cut, fresh_path

RECORD = "struct<offset:bigint,ts_ms:bigint>"


class RecordBuckets:
    """``records`` (KEY, offset, ts_ms) in ``buckets`` buckets, for marks with the columns of ``marks``.

    ``marks``: schema of the batches to come: KEY, base_offset and any other columns.
    """

    def __init__(
        self, records: DataFrame, marks: StructType, buckets: int, group_rows: int | None = None,
        bucket_offsets: int = BUCKET_OFFSETS,
    ):
        self.buckets, self.group_rows, self.bucket_offsets = buckets, group_rows, bucket_offsets
        self.extra = [f for f in marks.fields if f.name not in KEY and f.name != "base_offset"]
        self.kind = StructType(self.extra).simpleString() if self.extra else "struct<_:int>"
        whole = records.dropna(subset=KEY)
        self.hot = hot_slots(whole, KEY, group_rows)
        placed = whole.withColumn("_slot", slot(KEY))
        self.hot_records = cut(placed.join(self.hot, "_slot", "left_semi").select(*KEY, "offset", "ts_ms"), "hot-records")
        plain = placed.join(self.hot, "_slot", "left_anti")
        self.name = self._save(plain.select(
            *KEY, F.col("offset").alias("at"), F.lit(True).alias("is_record"), F.struct("offset", "ts_ms").alias("record"),
            F.lit(None).cast(self.kind).alias("extra"),
        ))

    def _save(self, lane: DataFrame) -> str:
        name = f"hopmeter_{uuid.uuid4().hex}"
        (
            lane.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", fresh_path(lane.sparkSession, "buckets")).saveAsTable(name)
        )
        return name

    def match(self, marks: DataFrame) -> DataFrame:
        """What ``first_match(records, marks)`` gives; the records are not shuffled."""
        spark = marks.sparkSession
        names = [f.name for f in self.extra]
        askable = F.col("base_offset").isNotNull()
        for c in KEY:
            askable = askable & F.col(c).isNotNull()
        placed = marks.filter(askable).withColumn("_slot", slot(KEY))
        extra = F.struct(*names) if names else F.struct(F.lit(0).alias("_"))
        lane = self._save(placed.join(self.hot, "_slot", "left_anti").select(
            *KEY, F.col("base_offset").alias("at"), F.lit(False).alias("is_record"),
            F.lit(None).cast(RECORD).alias("record"), extra.cast(self.kind).alias("extra"),
        ))
        # Both tables have one form and are read as they are, so that the union keeps their buckets. The filter, which
        # all rows pass, makes the scans give rows: Spark 4.1.2 puts columnar scans behind each other, not bucket to bucket.
        backwards = Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("is_record"), F.desc("record"))
        upto = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        there = F.col("at").isNotNull()
        both = spark.table(self.name).filter(there).union(spark.table(lane).filter(there))
        met = both.withColumn("hit", F.last("record", ignorenulls=True).over(upto))
        columns = [*KEY, "base_offset", *names, "offset", "ts_ms"]
        plain = met.filter("NOT is_record").select(
            *KEY, F.col("at").alias("base_offset"), *[f"extra.{n}" for n in names], "hit.offset", "hit.ts_ms"
        )
        rest = placed.join(self.hot, "_slot", "left_semi").drop("_slot").unionByName(marks.filter(~askable))
        return plain.unionByName(
            first_match(self.hot_records, rest, self.group_rows, self.bucket_offsets).select(columns)
        )

    def drop(self, spark) -> None:
        """Forget the table; its files go with the other stage tables."""
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
