"""Hash-chained audit log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
SCHEMA = "id bigint, ts timestamp, actor string, action string, detail string, prev_hash string, hash string"


def canonical_json(detail) -> str:
    """Sorted keys, no blanks, non-ASCII kept; floats are rejected, their text is not portable."""

    def check(value) -> None:
        if isinstance(value, float):
            raise TypeError("no floats in audit details")
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ():
            check(v)

    check(detail)
    return json.dumps(detail, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def entry_hash(prev: Column, ts: Column, actor: Column, action: Column, detail: Column) -> Column:
    """SHA-256 over the previous hash, the UTC time in microseconds, actor, action and detail."""
    # The instant whose reading in the session's zone is the UTC reading of ts.
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    shown = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.sha2(F.concat(prev, shown, actor, action, F.coalesce(detail, F.lit("null"))), 256)


def chained(rows: DataFrame) -> DataFrame:
    """Entries (id, ts, actor, action, detail) with `shown`, the time as it is hashed, as a log with their hashes.

    A chain is serial by nature: one task streams the rows in the order of their ids and holds one hash.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = GENESIS
        for batch in batches:
            before, own = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("shown", "actor", "action", "detail"))):
                shown, actor, action, detail = row
                before.append(prev)
                prev = hashlib.sha256((prev + shown + actor + action + (detail if detail is not None else "null")).encode()).hexdigest()
                own.append(prev)
            kept = [batch.column(c) for c in ("id", "ts", "actor", "action", "detail")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(own, pa.string())], ["id", "ts", "actor", "action", "detail", "prev_hash", "hash"])

    kept = rows.select("id", "ts", "actor", "action", "detail", "shown").repartition(1).sortWithinPartitions("id")
    return kept.mapInArrow(link, SCHEMA)


def append(spark: SparkSession, path: str, actor: str, action: str, detail=None, ts: datetime | None = None) -> str:
    """Append one entry to the log at path (Parquet) and return its hash. One writer at a time."""
    ts = (ts or datetime.now(timezone.utc)).astimezone(timezone.utc)
    try:
        last = spark.read.schema(SCHEMA).parquet(path).orderBy(F.col("id").desc()).select("id", "hash").first()
    except Exception as e:  # the log does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    prev, number = (last["hash"], last["id"] + 1) if last else (GENESIS, 1)
    text = canonical_json(detail) if detail is not None else None
    shown = ts.strftime("%Y-%m-%dT%H:%M:%S.%f") + "+00:00"
    digest = hashlib.sha256((prev + shown + actor + action + (text if text is not None else "null")).encode()).hexdigest()
    spark.createDataFrame([(number, ts, actor, action, text, prev, digest)], SCHEMA).write.mode("append").parquet(path)
    return digest


def verify(log: DataFrame) -> DataFrame:
    """(ok, n_entries, broken_at): whether every entry follows its predecessor, and the first that does not.

    Each entry's hash depends on its own stored prev_hash, so all are checked at once. Predecessors are
    found within id blocks and the blocks' ends joined, so no task holds the whole log.
    """
    rows = log.withColumn("_b", F.floor(F.col("id") / 100_000))
    line = Window.partitionBy("_b").orderBy("id")
    inner = rows.withColumns({"_prev": F.lag("hash").over(line), "_first": F.row_number().over(line) == 1})
    ends = rows.groupBy("_b").agg(F.max_by("hash", "id").alias("_end"))
    # One row per block of ids.
    before = ends.select("_b", F.lag("_end", 1, GENESIS).over(Window.orderBy("_b")).alias("_before"))
    linked = inner.join(before, "_b").withColumn("_want", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev")))
    fine = (F.col("prev_hash") == F.col("_want")) & (F.col("hash") == entry_hash(F.col("prev_hash"), F.col("ts"), F.col("actor"), F.col("action"), F.col("detail")))
    return linked.agg(
        (F.count_if(~F.coalesce(fine, F.lit(False))) == 0).alias("ok"), F.count(F.lit(1)).alias("n_entries"), F.min(F.when(~F.coalesce(fine, F.lit(False)), F.col("id"))).alias("broken_at")
    )
