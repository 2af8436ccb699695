"""Structured Streaming twins of batch operators; each gives what its batch twin gives once all input is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; times without a zone become instants in the session's zone, as watermarks need them."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in raw.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def window_counts(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sum per key and window; rows later than the watermark are dropped, windows come out once it passes them."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(w, key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.session_window(time, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; on a stream, state is kept no longer than the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Stream-static join: frames are read anew with each batch."""
    return events.join(frames, keys, "left")


def sequences(first: DataFrame, second: DataFrame, key: str, time: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of a first and a later second event of a key within an interval; watermarks on both sides bound the state."""
    a = first.withWatermark(time, late) if first.isStreaming else first
    b = second.withWatermark(time, late) if second.isStreaming else second
    a = a.select(F.col(key).alias("k1"), F.col(time).alias("t1"), F.col("event_id").alias("first_id"))
    b = b.select(F.col(key).alias("k2"), F.col(time).alias("t2"), F.col("event_id").alias("second_id"))
    return a.join(b, F.expr(f"k1 = k2 AND t2 > t1 AND t2 <= t1 + INTERVAL {within}")).select(F.col("k1").alias(key), "first_id", "second_id", "t1", "t2")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
