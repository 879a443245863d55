"""Streaming forms of the time-window and state-based operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.sessions import SessionTable


def beacon_counts(stream: DataFrame, keys: list[str], ts: str, bucket: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and ends of tumbling windows per key; rows later than `late` behind the latest are dropped."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(*keys, F.col("w.start").alias("bucket_start"), "n", "first_ts", "last_ts")
    )


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str = "1800 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions per key (gap inclusive), emitted once the watermark has passed them."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
        .drop("w")
    )


def first_deliveries(stream: DataFrame, record: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each source record once, its key remembered until the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([record])


def into_sessions(stream: DataFrame, sessions_table: SessionTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Feed micro-batches into a session table. Records already seen are skipped, so a replay changes nothing."""
    if not sessions_table.record:
        raise ValueError("a replayed batch needs the record key")
    return stream.writeStream.foreachBatch(lambda df, _: sessions_table.apply(prepare(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Append the new records of each micro-batch to a Parquet table; a replay appends nothing."""
    from siltstone.operators.upsert import idempotent_append

    return stream.writeStream.foreachBatch(lambda df, _: idempotent_append(df, path, key, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
