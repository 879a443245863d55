"""Repeated connections as beacon sessions in tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beacon_sessions(alerts: DataFrame, keys: list[str], ts: str, id_col: str, bucket_s: int = 300, many: int = 10, very_many: int = 20) -> DataFrame:
    """One row per key and bucket of bucket_s seconds (aligned to the epoch) with gap statistics.

    Columns: keys, bucket, n, first_us, last_us, mean_gap, std_gap (population, over the gaps between
    neighbours in seconds; null for one row), is_regular (std < mean / 2 + 2), is_beaconing, severity,
    first_id (the earliest row). Null keys form a group of their own. Rows without a time are left out.
    A bucket bounds what is ordered together; gaps are taken inside the same shuffle.
    """
    at = F.unix_micros(ts)
    rows = alerts.where(F.col(ts).isNotNull()).withColumns({"_at": at, "bucket": F.floor(at / F.lit(bucket_s * 1_000_000))})
    order = Window.partitionBy(*keys, "bucket").orderBy("_at", id_col)
    rows = rows.withColumn("_gap", (F.col("_at") - F.lag("_at").over(order)) / F.lit(1e6))
    out = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_at").alias("first_us"),
        F.max("_at").alias("last_us"),
        F.avg("_gap").alias("mean_gap"),
        F.stddev_pop("_gap").alias("std_gap"),
        F.min_by(id_col, F.struct("_at", id_col)).alias("first_id"),
    )
    regular = F.coalesce(F.col("std_gap") < F.col("mean_gap") * 0.5 + 2, F.lit(False))
    return out.withColumns({"is_regular": regular}).withColumns({
        "is_beaconing": (F.col("n") >= many) & F.col("is_regular"),
        "severity": F.when(((F.col("n") >= many) & F.col("is_regular")) | (F.col("n") >= very_many), "high").otherwise("medium"),
    })


def session_alerts(alerts: DataFrame, rule_id: str = "CUR-013", bucket_s: int = 300) -> DataFrame:
    """Alerts with all of one rule's hits replaced by one alert per host, process, peer, port and bucket.

    The alert is the session's earliest hit with the session's severity; `detail`, a JSON object, says
    what the session was, and is null for other alerts. Hits without a time are in no session and stay as
    they are. alerts is read three times; write it down before.
    """
    hits = alerts.where((F.col("rule_id") == rule_id) & F.col("ts").isNotNull())
    keys = ["host", "process_uid", "dst_ip", "dst_port"]
    graded = beacon_sessions(hits, keys, "ts", "event_id", bucket_s)

    def shown(us: str) -> Column:
        return F.date_format(F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    detail = F.to_json(F.struct(
        F.col("n").alias("connection_count"), shown("first_us").alias("first_seen"), shown("last_us").alias("last_seen"),
        F.round(F.coalesce("mean_gap", F.lit(0.0)), 2).alias("mean_gap_seconds"), "is_beaconing", "dst_ip", "dst_port",
    ))
    first = hits.drop("severity").join(graded.select(F.col("first_id").alias("event_id"), "severity", detail.alias("detail")), "event_id")
    return alerts.where((F.col("rule_id") != rule_id) | F.col("ts").isNull()).withColumn("detail", F.lit(None).cast("string")).unionByName(first)
