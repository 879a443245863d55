"""Sessions separated by inactivity gaps, kept in an incremental table.

Each batch of events is reduced to local sessions, compared with the stored sessions that lie within
the gap, bridged components are merged, and the affected cells are replaced atomically.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.keys import one_per_record
from siltstone.session import scratch_path

DAY_US = 86_400_000_000


def merge_intervals(sessions: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Merge sessions (start_us, end_us, n_events) of one key at most gap_us apart, bridges included."""
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col("start_us") - before <= gap_us, 0).otherwise(1)
    numbered = sessions.withColumn("_new", opened).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_no").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events")).drop("_no")


def local_sessions(events: DataFrame, keys: list[str], at_us: str, gap_us: int) -> DataFrame:
    """Sessions of a batch: keys, start_us, end_us, n_events. Rows with a null key or time take no part.

    Events of one key in one cell of gap_us always share a session, so they are combined before the
    shuffle; what one task orders is a key's cells, whose number is bounded by the time range.
    """
    whole = events.select(*keys, at_us)
    for c in (*keys, at_us):
        whole = whole.where(F.col(c).isNotNull())
    cells = (
        whole.withColumn("_cell", F.floor(F.col(at_us) / F.lit(max(1, gap_us))))
        .groupBy(*keys, "_cell")
        .agg(F.min(at_us).alias("start_us"), F.max(at_us).alias("end_us"), F.count(F.lit(1)).alias("n_events"))
    )
    return merge_intervals(cells.drop("_cell"), keys, gap_us)


class SessionTable:
    """Sessions on shared storage in cells (start day, bucket of the key), published through numbered manifests.

    A batch of events becomes local sessions. Stored cells of the same bucket that come within the gap of
    some local session are read, bridged sessions are merged, and new folders are written for the cells
    affected; all other cells stay as they are. Then a manifest is moved into place under the next
    number; readers see the old state or the new, never a mix. Nothing that an older manifest names is
    deleted by a batch, so readers of the old state can finish; `vacuum` does that later. A batch that
    dies before its manifest leaves the old state. Of two writers, the one that first creates the claim
    file of a number publishes it, the other fails; the store must create files exclusively.

    record names a column identifying the source record: repeated deliveries of one record, within a
    batch or across batches, count once (the first delivery, by order). Deliveries of a record agree in
    its time, so seen records are kept by event day and a batch reads those of its own days only.
    """

    CELLS = 16  #: buckets of the key; a late event rewrites one cell of a day, not the day
    SEEN_FOLDERS = 8  #: folders of seen records of one day before they are written into one

    def __init__(self, spark: SparkSession, path: str, keys: list[str], at_us: str, gap_us: int, record: str | None = None, order: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.at_us, self.gap_us = spark, path.rstrip("/"), keys, at_us, gap_us
        self.record, self.order = record, order
        self.schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), *(T.StructField(c, T.LongType()) for c in ("start_us", "end_us", "n_events"))])
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _versions(self) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._at("manifests")) if (n := s.getPath().getName()).endswith(".json")) if self._fs.exists(self._at("manifests")) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self) -> dict:
        names = self._versions()
        return self._load(names[-1]) if names else {"version": 0, "cells": {}, "seen": {}}

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['version']:09d}.json"
        try:
            self._fs.create(self._at(f"claims/{name}"), False).close()
        except Exception as e:
            raise RuntimeError(f"another writer claims version {manifest['version']} of {self.path}; if it has died, call recover()") from e
        out = self._fs.create(self._at(f"drafts/{name}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._at("manifests"))
        if not self._fs.rename(self._at(f"drafts/{name}"), self._at(f"manifests/{name}")):
            raise RuntimeError(f"could not publish {name}")

    def recover(self) -> None:
        """Drop the claims of writers that died before they published. Only while no writer is at work."""
        published = set(self._versions())
        if self._fs.exists(self._at("claims")):
            for s in self._fs.listStatus(self._at("claims")):
                if s.getPath().getName() not in published:
                    self._fs.delete(s.getPath(), False)

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last `keep` versions names, manifests included. Readers of older versions must be done."""
        names = self._versions()
        held: set[str] = set()
        for name in names[-keep:]:
            m = self._load(name)
            held |= {c["folder"].split("/")[1] for c in m["cells"].values()} | {f.split("/")[1] for folders in m["seen"].values() for f in folders}
        for kind in ("data", "seen"):
            if self._fs.exists(self._at(kind)):
                for s in self._fs.listStatus(self._at(kind)):
                    if s.getPath().getName() not in held and s.getPath().getName() <= names[-1].partition(".")[0]:
                        self._fs.delete(s.getPath(), True)
        for name in names[:-keep]:
            self._fs.delete(self._at(f"manifests/{name}"), False)
            self._fs.delete(self._at(f"claims/{name}"), False)

    def _stored(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The published sessions."""
        return self._stored([c["folder"] for _, c in sorted(self._manifest()["cells"].items())])

    def _fresh(self, batch: DataFrame, now: dict, version: int) -> tuple[DataFrame, dict]:
        """The batch's records that no batch before it held, written by event day, and the manifest's new list of seen records."""
        day = F.floor(F.col(self.at_us) / F.lit(DAY_US))
        fresh = one_per_record(batch, self.record, *self.order)
        for c in (*self.keys, self.at_us):
            fresh = fresh.where(F.col(c).isNotNull())
        fresh = fresh.select(self.record, *self.keys, self.at_us, day.alias("_day"))
        kind = T.StructType([fresh.schema[self.record]])
        seen = {d: list(folders) for d, folders in now["seen"].items()}
        if seen:
            # One row per day of the batch comes to the driver.
            days = {str(r[0]) for r in batch.select(day).distinct().collect()}
            held = [f"{self.path}/{f}" for d in sorted(days & seen.keys()) for f in seen[d]]
            if held:
                fresh = fresh.join(self.spark.read.schema(kind).parquet(*held), self.record, "left_anti")
        out = f"seen/{version:09d}"
        fresh.write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/{out}")
        if not self._fs.globStatus(self._at(f"{out}/_day=*")):
            return self.spark.createDataFrame([], fresh.drop("_day").schema), seen
        for status in self._fs.globStatus(self._at(f"{out}/_day=*")):
            name = status.getPath().getName()
            own = seen.setdefault(name.partition("=")[2], [])
            own.append(f"{out}/{name}")
            if len(own) > self.SEEN_FOLDERS:
                whole = f"seen/{version:09d}-{name.partition('=')[2]}"
                self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for f in own)).write.mode("overwrite").parquet(f"{self.path}/{whole}")
                own[:] = [whole]
        return self.spark.read.schema(fresh.drop("_day").schema).parquet(f"{self.path}/{out}"), seen

    def apply(self, batch: DataFrame) -> None:
        """Merge one batch of events into the table; an empty batch changes nothing."""
        now = self._manifest()
        version = now["version"] + 1
        seen = now["seen"]
        if self.record:
            batch, seen = self._fresh(batch, now, version)
        place = {"_day": F.floor(F.col("start_us") / F.lit(DAY_US)), "_cell": F.pmod(F.xxhash64(*self.keys), F.lit(self.CELLS))}
        spans = f"local/{version:09d}"
        local_sessions(batch, self.keys, self.at_us, self.gap_us).withColumns(place).write.mode("overwrite").parquet(f"{self.path}/{spans}")
        local = self.spark.read.parquet(f"{self.path}/{spans}")
        # A row per cell in which sessions of the batch start: bounded by days times buckets.
        touched = local.groupBy("_day", "_cell").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi")).collect()
        if not touched:
            if seen != now["seen"]:
                self._publish({"version": version, "cells": now["cells"], "seen": seen})
            return
        cells = {f"{r['_day']}/{r['_cell']}" for r in touched}
        of_bucket: dict[str, list] = {}
        for r in touched:
            of_bucket.setdefault(str(r["_cell"]), []).append(r)
        for name, c in now["cells"].items():
            near = of_bucket.get(name.partition("/")[2], ())
            if any(c["lo"] - self.gap_us <= r["hi"] and r["lo"] <= c["hi"] + self.gap_us for r in near):
                cells.add(name)
        stored = self._stored([now["cells"][c]["folder"] for c in sorted(cells) if c in now["cells"]])
        merged = merge_intervals(local.drop("_day", "_cell").unionByName(stored), self.keys, self.gap_us).withColumns(place)
        target = f"data/{version:09d}"
        merged.repartition("_day", "_cell").write.mode("overwrite").partitionBy("_day", "_cell").parquet(f"{self.path}/{target}")
        stats = self.spark.read.parquet(f"{self.path}/{target}").groupBy("_day", "_cell").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi")).collect()
        kept = {name: c for name, c in now["cells"].items() if name not in cells}
        kept |= {f"{r['_day']}/{r['_cell']}": {"folder": f"{target}/_day={r['_day']}/_cell={r['_cell']}", "lo": r["lo"], "hi": r["hi"]} for r in stats}
        self._publish({"version": version, "cells": kept, "seen": seen})
        self._fs.delete(self._at(spans), True)


def split_batches(events: DataFrame, arrival: str, n: int, drawn_from: DataFrame | None = None) -> list[DataFrame]:
    """Split into n batches by time of arrival, of about equal size; a null arrival goes to the first.

    One pass over the arrival column draws the cuts (of drawn_from, where that is cheaper to read than
    events) and one writes the rows by batch, so that reading a batch reads no other.
    """
    at = F.unix_micros(F.col(arrival)).cast("double")
    cuts = (events if drawn_from is None else drawn_from).agg(F.percentile_approx(at, [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] if n > 1 else None
    if not cuts:
        return [events]
    edges = sorted(set(cuts))
    number = F.lit(0)
    for i, edge in enumerate(edges, 1):
        number = F.when(at > edge, i).otherwise(number)
    path = scratch_path(events.sparkSession, "batches")
    events.withColumn("_batch", number).write.partitionBy("_batch").parquet(path)
    whole = events.sparkSession.read.schema(T.StructType([*events.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(path)
    return [whole.where(F.col("_batch") == i).drop("_batch") for i in range(len(edges) + 1)]
