"""Duplicate alerts: exact keys, and greedy near-duplicates by MinHash."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.minhash import PERMUTATIONS, signature, similarity, tokens

KEYS = ["rule_id", "host", "user_norm"]


def exact_key(rule: Column, host: Column, user: Column, process: Column, ts: Column, bucket_s: int = 60) -> Column:
    """SHA-256 of rule, host, user, process and time bucket joined by '|', nulls as empty."""
    bucket = F.floor(F.unix_micros(ts) / F.lit(bucket_s * 1_000_000)).cast("string")
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (rule, host, user, process)), bucket), 256)


def mark_exact(alerts: DataFrame, key: str = "dedup_key") -> DataFrame:
    """is_duplicate and canonical_id (the first of the key by time, then id) by exact key alone.

    The first of each key is found with map-side combination and joined back, so a key repeated very
    often needs no ordering in one task.
    """
    first = alerts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("ts", "id")).alias("_first"))
    out = alerts.join(first, key, "left")
    same = F.coalesce(F.col("_first.id") != F.col("id"), F.lit(False))
    return out.withColumns({"is_duplicate": same, "canonical_id": F.when(same, F.col("_first.id"))}).drop("_first")


class _Held:
    """The canonical alerts within reach: their keys, and their signatures as one array, compared at once."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.keys: deque[tuple[int, str]] = deque()
        self.at, self.ids, self.signatures, self.lo, self.hi = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros((16, PERMUTATIONS), np.int64), 0, 0

    def forget(self, before: int) -> None:
        """Drop what lies before a time."""
        while self.keys and self.keys[0][0] < before:
            self.seen.pop(self.keys.popleft()[1], None)
        while self.lo < self.hi and self.at[self.lo] < before:
            self.lo += 1

    def nearest(self, signature: np.ndarray, since: int, least: float) -> int | None:
        """The oldest alert since a time whose signature is similar enough."""
        lo = self.lo + int(np.searchsorted(self.at[self.lo : self.hi], since))
        similar = (self.signatures[lo : self.hi] == signature).sum(axis=1) / PERMUTATIONS >= least
        return int(self.ids[lo + int(similar.argmax())]) if similar.any() else None

    def add(self, at: int, number: int, key: str, signature: np.ndarray | None) -> None:
        self.seen[key] = number
        self.keys.append((at, key))
        if signature is None:
            return
        if self.hi == len(self.at):
            kept = slice(self.lo, self.hi)
            size = max(16, 2 * (self.hi - self.lo))
            for name in ("at", "ids", "signatures"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), np.int64)
                new[: self.hi - self.lo] = old[kept]
                setattr(self, name, new)
            self.lo, self.hi = 0, self.hi - self.lo
        self.at[self.hi], self.ids[self.hi], self.signatures[self.hi] = at, number, signature
        self.hi += 1


def mark_greedy(alerts: DataFrame, window_s: int = 300, least_similarity: float = 0.9, least_tokens: int = 3) -> DataFrame:
    """id, dedup_key, is_duplicate, canonical_id in the order-dependent greedy sense.

    By time, then id: an alert whose exact key was seen is a duplicate of its first holder; else, with
    enough tokens, of the oldest canonical alert of the last window_s seconds (inclusive) of the same
    rule, host and user whose signature is similar enough. A near-duplicate becomes no canonical one
    and does not register its key.

    A decision looks back by at most window_s, or one key bucket (60 s), so each (rule, host, user)
    group splits wherever a longer silence lies, and the pieces are independent. The silences are found
    on time cells, not on rows. A piece is one task's work, streamed in order with only the canonical
    alerts and keys within reach held: where alerts of one rule, host and user go on without a silence,
    greedy order leaves nothing to split.
    """
    rows = alerts.select("id", *KEYS, F.unix_micros("ts").alias("at"), exact_key(F.col("rule_id"), F.col("host"), F.col("user_norm"), F.col("process_uid"), F.col("ts")).alias("dedup_key"), tokens(F.col("command_line")).alias("_t"))
    rows = rows.withColumns({"n_tokens": F.size("_t"), "sig": F.when(F.size("_t") >= least_tokens, signature(F.col("_t")))}).drop("_t")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("dedup_key", T.StringType()), T.StructField("is_duplicate", T.BooleanType()), T.StructField("canonical_id", T.LongType())])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, _Held()
        for pdf in batches:
            dup, canon = [], []
            for row in pdf.itertuples(index=False):
                if (own := (row.rule_id, row.host, row.user_norm, row.piece)) != group:
                    group, held = own, _Held()
                held.forget(row.at - reach)
                telling = row.n_tokens >= least_tokens
                owner = held.seen.get(row.dedup_key)
                if owner is None and telling:
                    owner = held.nearest(row.sig, row.at - window_s * 1_000_000, least_similarity)
                if owner is None:
                    held.add(row.at, row.id, row.dedup_key, row.sig if telling else None)
                dup.append(owner is not None)
                canon.append(owner)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "dedup_key": pdf["dedup_key"].to_numpy(), "is_duplicate": dup, "canonical_id": pd.array(canon, dtype="Int64")})

    reach = max(window_s, 60) * 1_000_000
    rows = rows.withColumn("_cell", F.floor(F.col("at") / F.lit(reach)))
    cells = rows.groupBy(*KEYS, "_cell").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    line = Window.partitionBy(*KEYS).orderBy("_cell")
    far = F.when(F.col("_lo") - F.lag("_hi").over(line) > reach, 1).otherwise(0)
    cells = cells.withColumn("_new", far).withColumn("piece", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    for c in [*KEYS, "_cell"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rows = rows.alias("l").join(cells.select(*KEYS, "_cell", "piece").alias("r"), same).select("l.*", "r.piece").drop("_cell")
    return rows.repartition(*KEYS, "piece").sortWithinPartitions(*KEYS, "piece", "at", "id").mapInPandas(stream, schema)


def similar_pairs(alerts: DataFrame, window_s: int = 300) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: estimated Jaccard similarity of the command lines of alerts of one rule, host and user at most window_s apart.

    Rows meet in cells as long as the window and in the next one, so a rule, host and user with very many
    alerts is spread over time. Rows without a rule, time or command line take no part; a null host or
    user equals another.
    """
    span = window_s * 1_000_000
    rows = alerts.where(F.col("rule_id").isNotNull() & F.col("ts").isNotNull() & F.col("command_line").isNotNull())
    rows = rows.select("id", *KEYS, F.unix_micros("ts").alias("at"), signature(tokens(F.col("command_line"))).alias("sig")).withColumn("cell", F.floor(F.col("at") / F.lit(span)))
    key = F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in KEYS))
    rows = rows.withColumn("k", key)
    a = rows.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1))).alias("a")
    fits = (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("b.at") - F.col("a.at") <= span)
    for c in KEYS:
        fits = fits & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    later = (F.col("b.at") > F.col("a.at")) | ((F.col("b.at") == F.col("a.at")) & (F.col("b.id") > F.col("a.id")))
    pairs = a.join(rows.alias("b"), fits & later)
    return pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), similarity(F.col("a.sig"), F.col("b.sig")).alias("similarity"))


def apply_marks(alerts: DataFrame, marks: DataFrame) -> DataFrame:
    """Alerts with the marks of either operator in place of their own columns."""
    return alerts.drop("dedup_key", "is_duplicate", "canonical_id").join(marks.select("id", "dedup_key", "is_duplicate", "canonical_id"), "id", "left")

