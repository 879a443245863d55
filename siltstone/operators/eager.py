"""Per-key results without imbalance: eager aggregation through joins.

Both inputs of a join are first aggregated by the join key into compact states (with map-side
combination, so a key holding a third of all rows reaches the shuffle as a few rows). The states are
joined, counts multiplied and sums combined algebraically, and rolled up to the wanted groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import write_read


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    group_by: list[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
) -> DataFrame:
    """The aggregate of `left JOIN right USING (on)` by group_by, without forming the joined rows.

    group_by names columns of either input. Result: group_by, n_pairs (the joined rows), and every
    named sum over the joined rows: a left sum counts once per matching right row and vice versa.
    Null keys match nothing, as in the plain join; sums ignore nulls and are null if all are.
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    of_left = [c for c in group_by if c in left.columns and c not in on]
    of_right = [c for c in group_by if c not in left.columns]

    def compact(df: DataFrame, groups: list[str], count: str, sums: dict[str, Column], tag: str) -> DataFrame:
        whole = df
        for c in on:
            whole = whole.where(F.col(c).isNotNull())
        return whole.groupBy(*on, *groups).agg(F.count(F.lit(1)).alias(count), *(F.sum(v).alias(f"{tag}{k}") for k, v in sums.items()))

    a = compact(left, of_left, "_nl", left_sums, "_l_")
    b = compact(right, of_right, "_nr", right_sums, "_r_")
    return (
        a.join(b, on)
        .groupBy(*group_by)
        .agg(
            F.sum(F.col("_nl") * F.col("_nr")).alias("n_pairs"),
            *(F.sum(F.col(f"_l_{k}") * F.col("_nr")).alias(k) for k in left_sums),
            *(F.sum(F.col(f"_r_{k}") * F.col("_nl")).alias(k) for k in right_sums),
        )
    )


def key_states(events: DataFrame, keys: list[str], at_us: str, tie: str | None = None) -> DataFrame:
    """Compact states in time order: keys, n, first_us, last_us and gap_us (the longest gap inside, 0 for one row).

    Rows are range-partitioned by (keys, time), so partitions are of about one size however uneven the
    keys: a hot key is cut at points in time, small keys lie together. Every partition reduces each of its
    keys to one state, in one streaming pass over the sorted rows; there are as many states as keys plus
    partitions at most. tie names a column that tells rows of one key and instant apart, by which those
    are split too where they are very many.
    """
    rows = events.select(*keys, F.col(at_us).cast("bigint").alias("_at"), *([F.xxhash64(tie).alias("_tie")] if tie else []))
    order = [*keys, "_at", *(["_tie"] if tie else [])]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*keys, "_at").select(*keys, "_at")
    fields = [rows.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in ("n", "first_us", "last_us", "gap_us")]
    return rows.mapInArrow(_reduce(len(keys)), T.StructType(fields))


def _reduce(n_keys: int):
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the state of the last key so far
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            at = batch.column(n_keys).to_numpy()
            new = np.zeros(size, dtype=bool)
            new[0] = True
            for k in range(n_keys):
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            step = np.diff(at, prepend=at[:1])
            step[start] = 0
            n, first, last, gap = np.diff(np.append(start, size)), at[start], at[np.append(start[1:], size) - 1], np.maximum.reduceat(step, start)
            names = batch.schema.names[:n_keys]
            found = [batch.column(k).take(pa.array(start)) for k in range(n_keys)]
            if held is not None:
                if all(held.column(k)[0] == found[k][0] for k in range(n_keys)):
                    before = [held.column(n_keys + j)[0].as_py() for j in range(4)]
                    n[0] += before[0]
                    gap[0] = max(gap[0], before[3], first[0] - before[2])
                    first[0] = before[1]
                else:
                    yield held
            out = pa.RecordBatch.from_arrays([*found, *(pa.array(c, pa.int64()) for c in (n, first, last, gap))], [*names, "n", "first_us", "last_us", "gap_us"])
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return states


def longest_gap_by_key(events: DataFrame, keys: list[str], at_us: str, tie: str | None = None) -> DataFrame:
    """keys, n_events and max_gap_us (longest time between neighbours, 0 for a single event).

    The tails and the heads of neighbouring states of a key are the two compact inputs (key_states),
    joined on key and position; counts are summed and gaps combined by maximum. Rows with a null key or
    time are left out; equal times give a gap of 0. A key has as many states as partitions it reaches
    into, so ordering them is no task's burden.
    """
    whole = events.select(*keys, at_us, *([tie] if tie else []))
    for c in (*keys, at_us):
        whole = whole.where(F.col(c).isNotNull())
    states = key_states(whole, keys, at_us, tie)
    place = states.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("first_us", "last_us")))
    place = write_read(place, "states")
    tails = place.select(*keys, "_at", "n", "gap_us", "last_us")
    heads = place.select(*keys, (F.col("_at") - 1).alias("_at"), F.col("first_us").alias("_next")).where("_at > 0")
    between = F.greatest(F.col("gap_us"), F.coalesce(F.col("_next") - F.col("last_us"), F.lit(0)))
    return (
        tails.join(heads, [*keys, "_at"], "left")
        .groupBy(*keys)
        .agg(F.sum("n").cast("bigint").alias("n_events"), F.max(between).cast("bigint").alias("max_gap_us"))
    )
