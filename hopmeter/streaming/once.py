"""First record per key, told once: an append stream for consumers that can't merge on read.

``jobs.first_per_key`` keeps no state and may write a key in several batches. Here a key is
one row. The state holds the least offset of a key's records, which belong together
as long as no more than ``pause`` lies between their broker times; when the watermark has
passed the last one by as much, the row is written and the key leaves the state. A
key that is seen again after that is a new key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hopmeter.operators.first_match import KEY
from hopmeter.sources.topics import scan_from
from hopmeter.streaming.jobs import batch_path, settings, start, state_settings


def first_once(
    records: DataFrame, bounds: DataFrame, out: str, checkpoint: str, pause: str, lateness: str,
    state_partitions: int | None = None, every: str | None = None,
) -> StreamingQuery:
    """Smallest offset per topic and key at or after the topic partition's bound, one row per key.

    ``pause`` and ``lateness`` are intervals such as "10 minutes"; a record counts if it comes
    no more than ``lateness`` behind the newest broker time.
    """
    at = records.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", lateness)
    firsts = scan_from(at, bounds).groupBy(F.session_window("_at", pause), *KEY).agg(
        F.min(F.struct("offset", "ts_ms")).alias("hit")
    ).select(*KEY, "hit.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(out, batch_id))

    with settings(records.sparkSession, state_settings(state_partitions)):
        return start(firsts, checkpoint, write, every=every)
