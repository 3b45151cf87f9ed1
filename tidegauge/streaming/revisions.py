"""A stream of revisions: repeated ones dropped, intervals kept per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_revisions(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Revisions(indicator_id, area_code, obs_date, value, realtime_start) without repeats that arrive within the delay.

    Event time is the time of arrival, so that a revision is never too late, however
    far back its realtime_start lies; a repeat that arrives after the delay is kept.
    State is bounded by what arrives within the delay.
    """
    return stream.withColumn("event_time", F.current_timestamp()).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        ["indicator_id", "area_code", "obs_date", "value", "realtime_start"]
    )


def windowed_counts(stream: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Revisions per indicator and window of event time."""
    timed = stream.withColumn("event_time", F.col("realtime_start").cast("timestamp"))
    return timed.withWatermark("event_time", delay).groupBy(F.window("event_time", width), "indicator_id").agg(
        F.count("*").alias("revisions"), F.avg("value").alias("mean")
    )


def append_batches(stream: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None):
    """Append each micro-batch under path/batch=N, so that a repeated batch replaces itself; returns the query."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.drop("event_time").write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if after:
            after(batch, epoch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
