"""Landed pages that are delivered more than once, taken once.

The state store holds the keys of the pages of the last while, whatever the store of
observations holds: a page that comes again within ``delay`` of its own time is
dropped, state beyond it is let go, and what comes later than that is dropped as
too late.  A run that was stopped goes on from its checkpoint with the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.schemas import LANDED

DELIVERED = LANDED + ", landed_at TIMESTAMP"


def once(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each page of a stream once: its request, its place there and its body."""
    digest = F.sha2(F.concat_ws("\0", F.coalesce("error", F.lit("")), F.coalesce("body", F.lit(""))), 256)
    return (
        pages.withColumn("_digest", digest)
        .withWatermark("landed_at", delay)
        .dropDuplicatesWithinWatermark(["request_id", "landed_seq", "_digest"])
        .drop("_digest")
    )


def deliver_once(
    spark: SparkSession, landing: str, out: str, checkpoint: str, delay: str = "1 day",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the pages that have landed since the last run to ``out``, then stop."""
    reader = spark.readStream.schema(DELIVERED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        once(reader.json(landing), delay)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
