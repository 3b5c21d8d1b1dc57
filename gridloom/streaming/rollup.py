"""The monthly roll-up and the summary counts on a stream of daily events.

The batch operators stay the definition; these are the same aggregations with a
watermark, so late events are merged until the watermark passes and state is
dropped afterwards.  Daily totals are tumbling windows; months are tumbling in
the downstream batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Sum and count per key and day, append-safe under the watermark."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return (
        stamped.groupBy(F.window("_ts", "1 day").alias("_w"), key)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        .select(key, F.to_date("_w.start").alias("day"), "total", "n")
    )


def write_daily(stream: DataFrame, path: str, checkpoint: str):
    """Append finished days to a Parquet table; one trigger over what is there."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
