"""Filling fixed-capacity containers: bound-certified repacking.

Items are packed by best-fit decreasing within bounded partitions. Dual feasible functions give a lower
bound on each partition's containers, and on all of a spec. A partition that meets its bound is certified.
Partitions with a gap give up the items of all their unfilled containers, certified ones those of their
emptiest container only, as rounding up to whole containers leaves one such in each. What is given up
is dealt anew, so that partitions exchange items, and packed again. A spec is done when it meets its own
bound (certified), or when a round saves no container: then the packing before it stays. Every other
round saves at least one, so no limit on rounds is needed.

An item longer than a container is split: full containers first, its remainder is an item like any
other. Nothing else is split. Items of size 0 or null give no piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count as counting

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import write_read

#: Items of a partition: what one call packs. Small enough for many partitions, large enough to fill containers well.
PARTITION_ITEMS = 4096
_PACKED = "spec_id int, capacity int, part bigint, item_id bigint, piece int, start bigint, size bigint, bin int, bin_size bigint, n_bins int, bound int, lead boolean, tail boolean"


@dataclass
class Packing:
    """pieces: spec_id, item_id, piece, start, size, container (a name unique in its spec).

    rounds, a row per spec and round: n_parts, n_certified (partitions that met their bound), n_items,
    and n_before and n_after, the containers of these items before and after (no value in round 0).
    bounds: spec_id, least_containers, the dual-feasible bound over all items of the spec.
    """

    pieces: DataFrame
    rounds: DataFrame
    bounds: DataFrame


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs of count[s] items of size s, by two families of dual feasible functions (integers only)."""
    count = count.astype(np.int64)
    if not count.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    many, weight = np.concatenate([[0], count.cumsum()]), np.concatenate([[0], (count * x).cumsum()])
    # Sizes above capacity - e count as full, those below e as nothing.
    e = np.arange(1, capacity // 2 + 1, dtype=np.int64)
    full = many[-1] - many[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = max(best, int((full + -(-middle // capacity)).max(initial=0)))
    # Sizes rounded down to parts of 1/k, except those that divide evenly.
    for k in range(1, 33):
        even = (x * (k + 1)) % capacity == 0
        value = np.where(even, x * k, (x * (k + 1)) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """bound_of_counts of a list of sizes."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item; each goes, largest first, where the least space stays."""
    order = np.argsort(-sizes, kind="stable")
    placed = np.empty(len(sizes), dtype=np.int32)
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a container has r tokens of room
    bins = 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            b, room = bins, capacity
            bins += 1
        placed[i] = b
        room -= size
        if room:
            open_by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return placed


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item_id", "piece"], kind="stable", ignore_index=True)
    capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["size"].to_numpy(dtype=np.int64)
    placed = best_fit_decreasing(sizes, capacity)
    used = np.bincount(placed, weights=sizes).astype(np.int64)
    lead = np.zeros(len(sizes), dtype=bool)
    lead[np.unique(placed, return_index=True)[1]] = True
    return pdf.assign(bin=placed, bin_size=used[placed], n_bins=len(used), bound=lower_bound(sizes, capacity), lead=lead, tail=placed == used.argmin())


def pieces(items: DataFrame, id_col: str, size_col: str, specs: list[tuple[int, int]]) -> DataFrame:
    """spec_id, capacity, item_id, piece, start, size, whole: an item's pieces for every spec.

    specs are (spec_id, capacity) pairs. whole marks pieces that fill a container by themselves.
    """
    each = F.explode(F.array(*(F.struct(F.lit(int(s)).alias("spec_id"), F.lit(int(c)).alias("capacity")) for s, c in specs)))
    rows = items.where(F.col(size_col) > 0).select(F.col(id_col).cast("bigint").alias("item_id"), F.col(size_col).cast("bigint").alias("_n"), each.alias("_s")).select("item_id", "_n", "_s.*")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.col("capacity"))))
    rows = rows.withColumn("piece", cut)
    start = F.col("piece") * F.col("capacity")
    size = F.least(F.col("capacity").cast("bigint"), F.col("_n") - start)
    return rows.select("spec_id", "capacity", "item_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), size.alias("size"), (size == F.col("capacity")).alias("whole"))


def spec_bounds(cut: DataFrame) -> DataFrame:
    """(spec_id, least_containers) of pieces: the dual-feasible bound over all of a spec, from the counts by size."""
    counts = cut.groupBy("spec_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        count = np.bincount(pdf["size"].to_numpy(np.int64), weights=pdf["n"].to_numpy(np.float64), minlength=capacity + 1)
        return pd.DataFrame({"spec_id": pdf["spec_id"].iloc[:1], "least_containers": [bound_of_counts(count.round(), capacity)]})

    return counts.groupBy("spec_id").applyInPandas(bound, "spec_id int, least_containers bigint")


def _by_spec(values: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(int(x)) for kv in values.items() for x in kv))[F.col("spec_id")]


def pack(items: DataFrame, id_col: str, size_col: str, specs: list[tuple[int, int]], partition_items: int = PARTITION_ITEMS) -> Packing:
    """Pack the pieces of all items for every spec.

    partition_items bounds what is packed at once, whatever the number of rows; items are dealt to
    partitions by hash, so equal or repeated ones do not gather. Pieces, partitions and their gaps stay
    in tables; only a row of sums per spec comes to the driver in each round.
    """
    if not specs:
        raise ValueError("no container specs")
    spark = items.sparkSession
    # Numbers tell pieces apart, so that items of one id are packed each by itself.
    cut = write_read(pieces(items, id_col, size_col, specs).withColumn("number", F.monotonically_increasing_id()), "pieces")
    bounds = write_read(spec_bounds(cut), "bounds")
    least = {r["spec_id"]: r["least_containers"] for r in bounds.collect()}
    sums = cut.groupBy("spec_id").agg(F.count_if("whole").alias("whole"), F.count_if(~F.col("whole")).alias("n")).collect()
    done = [cut.where("whole").select("spec_id", "item_id", "piece", "start", "size", F.concat_ws("-", F.lit("full"), "number").alias("container"))]
    pool = cut.where("not whole").drop("whole", "number")
    finished = {r["spec_id"]: r["whole"] for r in sums}  # containers that no round touches any more
    waiting = {r["spec_id"]: r["n"] for r in sums if r["n"]}
    before: dict[int, int] = {}
    held: DataFrame | None = None
    log = []
    for round_ in counting():
        if not waiting:
            break
        n_parts = _by_spec({s: math.ceil(n / partition_items) for s, n in waiting.items()})
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("item_id", "piece", F.lit(round_)), n_parts))
        cols = ["spec_id", "capacity", "part", "item_id", "piece", "start", "size"]
        packed = write_read(dealt.select(cols).groupBy("spec_id", "part").applyInPandas(_pack, _PACKED), f"packed-{round_}")
        moving = (F.col("bin_size") < F.col("capacity")) & (F.col("tail") | (F.col("n_bins") > F.col("bound")))
        parts = packed.groupBy("spec_id", "part").agg(
            F.first("n_bins").alias("bins"), F.first("bound").alias("bound"), F.count_if(moving).alias("n"), F.count_if(moving & F.col("lead")).alias("bins_moving")
        )
        sums = parts.groupBy("spec_id").agg(
            F.count(F.lit(1)).alias("parts"), F.count_if(F.col("bins") <= F.col("bound")).alias("certified"), F.sum("bins").alias("bins"), F.sum("n").alias("n"), F.sum("bins_moving").alias("bins_moving")
        ).collect()
        log += [(r["spec_id"], round_, r["parts"], r["certified"], waiting[r["spec_id"]], before.get(r["spec_id"]), r["bins"]) for r in sums]
        # A repacking is taken only where it needs fewer containers than the items had.
        worse = [r["spec_id"] for r in sums if round_ and r["bins"] >= before[r["spec_id"]]]
        if worse:
            done.append(_named(held.where(F.col("spec_id").isin(worse)), round_ - 1))
            packed = packed.where(~F.col("spec_id").isin(worse))
        # Certified as a whole, or packed in one piece with nothing to exchange: done.
        again = [r for r in sums if r["spec_id"] not in worse and r["parts"] > 1 and r["bins_moving"] > 1 and finished[r["spec_id"]] + r["bins"] > least[r["spec_id"]]]
        for r in again:
            finished[r["spec_id"]] += r["bins"] - r["bins_moving"]
        waiting, before = {r["spec_id"]: r["n"] for r in again}, {r["spec_id"]: r["bins_moving"] for r in again}
        leaves = moving & F.col("spec_id").isin(list(waiting))
        done.append(_named(packed.where(~leaves), round_))
        held = packed.where(leaves)
        pool = held.select("spec_id", "capacity", "item_id", "piece", "start", "size")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return Packing(out, spark.createDataFrame(log, "spec_id int, round int, n_parts bigint, n_certified bigint, n_items bigint, n_before bigint, n_after bigint"), bounds)


def _named(packed: DataFrame, round_: int) -> DataFrame:
    return packed.select("spec_id", "item_id", "piece", "start", "size", F.concat_ws("-", F.lit(f"r{round_}"), "part", "bin").alias("container"))


def packing_report(packing: Packing, specs: list[tuple[int, int]]) -> DataFrame:
    """Per spec: containers, pieces, tokens, the fullest container, share of the room used, the containers packed in an
    exchange (n_exchanged), the dual-feasible lower bound least_containers, and whether it is met (certified)."""
    capacity = _by_spec(dict(specs))
    out = packing.pieces.groupBy("spec_id", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    first = F.startswith("container", F.lit("full-")) | F.startswith("container", F.lit("r0-"))
    out = out.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.count_if(~first).alias("n_exchanged")
    )
    out = out.join(packing.bounds, "spec_id")
    return out.withColumns({"fill": F.col("n_tokens") / (F.col("n_containers") * capacity), "certified": F.col("n_containers") == F.col("least_containers")})
