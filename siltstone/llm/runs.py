"""Runs of repeated consecutive events, found by regular expression over symbol strings.

Events are sorted by entity and time. In chunks of bounded length, every kind of event is mapped to
Unicode code points, the chunk becomes a string, in which each entity's symbols stand together, a
backreference finds the repetitions, and the spans are mapped back to identifiers and times.

Where a run must end, at a gap longer than allowed or at the next entity, the symbols change: each kind
has two code points, and the one in use alternates at every such place, so that no position is spent on
a separator. The mapping is made anew for each chunk, which holds no more kinds than events, so there is
no limit on the number of kinds and no table of them to be kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import write_read

FIRST_CODE_POINT = 0x10000
CHUNK = 50_000
_RUN = re.compile(r"(.)\1*", re.S)
_NAMES = ["entity", "kind", "first_id", "last_id", "first_us", "last_us", "n_events"]
_SPANS = "entity string, kind string, first_id bigint, last_id bigint, first_us bigint, last_us bigint, n_events bigint, edge boolean, part int"


def symbols(numbers: np.ndarray, cut: np.ndarray) -> str:
    """The string of kinds by number, whose code points alternate at every cut."""
    points = (FIRST_CODE_POINT + 2 * numbers + np.cumsum(cut) % 2).astype("<u4")
    return points.tobytes().decode("utf-32-le")


def collapse_runs(events: DataFrame, entity: str, kind: str, id_col: str, at_us: str, gap_us: int, least: int = 1) -> DataFrame:
    """Runs of the same kind: entity, kind, first_id, last_id, first_us, last_us, n_events.

    Order is by time, then id; neighbours in a run are at most gap_us apart (inclusive). Rows with a
    null entity, time or id take no part. An unknown kind (null) ends a run and makes none. least leaves
    out shorter runs.

    Rows are range-partitioned by entity, time and id, so an entity with very many events is cut at
    points in time. A partition streams its chunks and carries an open run from one to the next; only
    its first and its last run may go on in another partition, and those are stitched afterwards.
    """
    rows = events.select(F.col(entity).cast("string").alias("entity"), F.col(kind).cast("string").alias("kind"), F.col(id_col).cast("bigint").alias("id"), F.col(at_us).cast("bigint").alias("at"))
    order = ["entity", "at", "id"]
    rows = rows.where("entity is not null and id is not null and at is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    spans = write_read(rows.mapInArrow(_match(gap_us, least), _SPANS), "spans")
    # Two spans a partition at most, in the order of the partitions.
    edges = spans.where("edge")
    line = Window.partitionBy("entity").orderBy("first_us", "first_id")
    joined = (F.lag("part").over(line) != F.col("part")) & F.lag("kind").over(line).eqNullSafe(F.col("kind")) & (F.col("first_us") - F.lag("last_us").over(line) <= gap_us)
    edges = edges.withColumn("new", F.when(joined, 0).otherwise(1))
    edges = edges.withColumn("no", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy("entity", "no").agg(
        F.first("kind").alias("kind"),
        F.min_by("first_id", F.struct("first_us", "first_id")).alias("first_id"),
        F.max_by("last_id", F.struct("last_us", "last_id")).alias("last_id"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("n_events").alias("n_events"),
    )
    out = whole.select(_NAMES).unionByName(spans.where("not edge").select(_NAMES))
    return out.where((F.col("n_events") >= least) & F.col("kind").isNotNull())


def _match(gap_us: int, least: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("entity", pa.string()), ("kind", pa.string()), *((c, pa.int64()) for c in _NAMES[2:]), ("edge", pa.bool_()), ("part", pa.int32())])
        opened: dict | None = None  # the run that the next chunk may go on with

        def built(columns: dict, keep: np.ndarray | None = None) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({**columns, "part": np.full(len(columns["entity"]), part, np.int32)}, schema)
            return batch if keep is None else batch.filter(pa.array(keep))

        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                entity, kind = batch.column(0), batch.column(1)
                ids, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                size = len(ids)
                cut = np.zeros(size, dtype=bool)
                cut[1:] = pc.not_equal(entity.slice(1), entity.slice(0, size - 1)).to_numpy(zero_copy_only=False) | (np.diff(at) > gap_us)
                numbers = pc.fill_null(kind.dictionary_encode().indices.cast(pa.int64()), -1).to_numpy() + 1
                found = np.array([m.span() for m in _RUN.finditer(symbols(numbers, cut))])
                first, last = found[:, 0], found[:, 1] - 1
                columns = {
                    "entity": entity.take(pa.array(first)), "kind": kind.take(pa.array(first)), "first_id": ids[first].copy(), "last_id": ids[last],
                    "first_us": at[first].copy(), "last_us": at[last], "n_events": found[:, 1] - found[:, 0], "edge": np.zeros(len(found), dtype=bool),
                }
                if opened is None:
                    columns["edge"][0] = True
                else:
                    same = opened["entity"] == columns["entity"][0].as_py() and opened["kind"] == columns["kind"][0].as_py()
                    if same and at[0] - opened["last_us"] <= gap_us:
                        columns["first_id"][0], columns["first_us"][0], columns["edge"][0] = opened["first_id"], opened["first_us"], opened["edge"]
                        columns["n_events"][0] += opened["n_events"]
                    elif opened["edge"] or (opened["n_events"] >= least and opened["kind"] is not None):
                        yield built({k: [v] for k, v in opened.items()})
                opened = {k: v[-1].as_py() if isinstance(v, pa.Array) else v[-1].item() for k, v in columns.items()}
                keep = columns["edge"] | ((columns["n_events"] >= least) & columns["kind"].is_valid().to_numpy(zero_copy_only=False))
                keep[-1] = False
                yield built(columns, keep)
        if opened is not None:
            opened["edge"] = True
            yield built({k: [v] for k, v in opened.items()})

    return spans
