"""Mixing sources to target weights, in blocks of tokens.

Each source's texts are laid end to end and cut into blocks of equal length. Every output shard draws
multinomial counts of its slots per source; a source's slots are numbered through, and a pseudorandom
permutation of its block indices (a new one for every pass over the source) says which block fills a
slot. Blocks are joined by index. The number of passes is capped. `token_blocks` writes the blocks out
as tokens.

The mixture is as large as the shares allow: the source that runs out first at its share, all its
passes used, sets the size. A source without tokens takes no part, and the others' shares keep their
proportions; the report shows target and actual shares of all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 128
SLOTS_PER_SHARD = 4096
#: Documents of a source whose offsets one task sums up.
BUCKET_DOCS = 20_000


def source_key(source: Column) -> Column:
    """One spelling per source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s-]+", "_")


def lay_out(items: DataFrame, block_tokens: int, docs: dict[str, int]) -> DataFrame:
    """Pieces (source, block, offset, doc_id, start, size) of the sources' texts laid end to end; offset is the place in the block.

    items: source, doc_id, n (tokens, more than 0); docs: the number of documents of every source. The
    running offsets are summed in buckets of a source, as many as its documents ask for, and bucket
    totals are added, so no task holds a whole source, whatever its size.
    """
    buckets = F.coalesce(_looked_up({s: math.ceil(n / BUCKET_DOCS) for s, n in docs.items()}, F.col("source")), F.lit(1).cast("bigint"))
    rows = items.withColumn("_b", F.pmod(F.xxhash64("doc_id"), buckets))
    within = Window.partitionBy("source", "_b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "_b").agg(F.sum("n").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    rows = rows.withColumn("_at", F.sum("n").over(within) - F.col("n"))
    rows = rows.join(totals.select("source", "_b", "_base"), ["source", "_b"]).withColumn("_at", F.col("_at") + F.col("_base"))
    first, last = F.floor(F.col("_at") / F.lit(block_tokens)), F.floor((F.col("_at") + F.col("n") - 1) / F.lit(block_tokens))
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_at"), F.col("block") * F.lit(block_tokens))
    hi = F.least(F.col("_at") + F.col("n"), (F.col("block") + 1) * F.lit(block_tokens))
    offset = lo - F.col("block") * F.lit(block_tokens)
    return rows.select("source", "block", offset.alias("offset"), "doc_id", (lo - F.col("_at")).alias("start"), (hi - lo).alias("size"))


def _looked_up(values: dict[str, int], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("bigint")
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))[key]


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block_tokens: int) -> dict[str, int]:
    """Slots of each source: as many as shares and caps allow, by largest remainders."""
    there = {s: w for s, (w, m) in targets.items() if w > 0 and m > 0 and tokens.get(s, 0) > 0}
    if not there:
        return {}
    weight = sum(there.values())
    room = {s: math.ceil(tokens[s] / block_tokens) * targets[s][1] for s in there}
    # The last block of a source may be short: its tokens, not its blocks, set what the source can give.
    slots = min(tokens[s] * targets[s][1] / block_tokens / (w / weight) for s, w in there.items())
    ideal = {s: slots * w / weight for s, w in there.items()}
    out = {s: min(room[s], math.floor(x)) for s, x in ideal.items()}
    for s in sorted(there, key=lambda s: (out[s] - ideal[s], s)):
        if sum(out.values()) < round(slots) and out[s] < room[s]:
            out[s] += 1
    return {s: max(1, n) for s, n in out.items()}


def drawn(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts that sum to want, with what is left of each quota as odds and as limit."""
    if want >= left.sum():
        return left.copy()
    out = np.minimum(rng.multinomial(want, left / left.sum()), left)
    for i in np.argsort(out - left, kind="stable"):
        out[i] += min(want - int(out.sum()), int(left[i] - out[i]))
    return out


def shard_counts(slots: dict[str, int], seed: int, slots_per_shard: int = SLOTS_PER_SHARD, shard: int = 0, first: dict[str, int] | None = None) -> pd.DataFrame:
    """Rows (shard, source, first, n): multinomial draws per shard, numbered from shard and from each source's first slot.

    Drawing against the remaining quotas lets the shards vary as multinomial counts do while their sum
    meets every quota.
    """
    rng, names = np.random.default_rng([seed, shard]), sorted(slots)
    left = np.array([slots[s] for s in names], dtype=np.int64)
    at, rows = np.array([(first or {}).get(s, 0) for s in names], dtype=np.int64), []
    while left.sum() > 0:
        own = drawn(left, min(slots_per_shard, int(left.sum())), rng)
        rows += [(shard, s, int(f), int(n)) for s, f, n in zip(names, at, own) if n]
        at, left, shard = at + own, left - own, shard + 1
    return pd.DataFrame(rows, columns=["shard", "source", "first", "n"]).astype({"shard": "int64", "first": "int64", "n": "int64"})


def shard_table(spark: SparkSession, slots: dict[str, int], seed: int, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """shard_counts as a table, drawn in two steps: the quotas of groups of shards on the driver, the shards of a group in a task.

    With S shards there are about sqrt(S) groups of sqrt(S) shards, so neither step grows with S itself,
    and there is no limit on shards.
    """
    total = sum(slots.values())
    shards = math.ceil(total / slots_per_shard) if total else 0
    group_slots = slots_per_shard * max(1, math.isqrt(shards))
    groups = shard_counts(slots, seed, group_slots)
    schema = "shard bigint, source string, first bigint, n bigint"
    if groups.empty:
        return spark.createDataFrame([], schema)
    # Group g holds the shards from g * group_slots / slots_per_shard on.
    step = group_slots // slots_per_shard

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["shard"].iloc[0]) * step
        own = dict(zip(pdf["source"], pdf["n"].astype(int)))
        return shard_counts(own, seed, slots_per_shard, start, dict(zip(pdf["source"], pdf["first"].astype(int))))

    return spark.createDataFrame(groups, schema).groupBy("shard").applyInPandas(split, schema)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of index under a pseudorandom permutation of range(size): a keyed Feistel network, walked back into range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        # Numbers wrap at 64 bits, as hashing wants.
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(6):
            mixed = (right + key[todo] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = out >= size
    return out.astype(np.int64)


def permuted_column(index: Column, size: Column, key: Column) -> Column:
    """permuted() over columns."""

    @F.pandas_udf("bigint")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)))

    return place.asNondeterministic()(index, size, key)  # else a join would evaluate it twice


def mix(blocks: DataFrame, tokens: dict[str, int], targets: dict[str, tuple[float, int]], seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: shard, slot (within the source), source, repeat, block, offset, doc_id, start, size.

    blocks: the pieces of lay_out; tokens: their sum by source; targets: share and most uses by source.
    Within one pass every block is used at most once, and there are at most as many passes as uses
    allowed, so no piece of a text is used more often.
    """
    slots = quotas(tokens, targets, block_tokens)
    shards = shard_table(blocks.sparkSession, slots, seed)
    sizes = _looked_up({s: math.ceil(tokens[s] / block_tokens) for s in slots}, F.col("source"))
    rows = shards.repartition(F.col("shard")).withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    rows = rows.withColumn("_size", sizes).withColumn("repeat", F.floor(F.col("slot") / F.col("_size")))
    rows = rows.withColumn("block", permuted_column(F.pmod(F.col("slot"), F.col("_size")), F.col("_size"), F.xxhash64("source", "repeat", F.lit(seed))))
    # The slots are counted out from a small table, so their size estimate is far too low to broadcast them by.
    return rows.select("shard", "slot", "source", "repeat", "block").hint("merge").join(blocks, ["source", "block"])


def token_blocks(mixture: DataFrame, blocks: DataFrame, documents: DataFrame, tokens: Column) -> DataFrame:
    """The mixture as token sequences: shard, slot, source, repeat, block, tokens (array of token ids).

    documents: doc_id and what the column tokens, an array of the document's token ids, is made from.
    Every document is tokenised once and cut into its pieces, the pieces of a block are put together, and
    the slots take the finished blocks by index; the last block of a source may be short.
    """
    known = documents.select("doc_id", tokens.alias("_all"))
    cut = blocks.join(known, "doc_id").select("source", "block", "offset", F.slice("_all", (F.col("start") + 1).cast("int"), F.col("size").cast("int")).alias("_t"))
    whole = cut.groupBy("source", "block").agg(F.collect_list(F.struct("offset", "_t")).alias("_p"))
    whole = whole.select("source", "block", F.flatten(F.transform(F.array_sort("_p"), lambda p: p["_t"])).alias("tokens"))
    slots = mixture.select("shard", "slot", "source", "repeat", "block").distinct()
    return slots.hint("merge").join(whole, ["source", "block"])


def document_uses(mixture: DataFrame) -> DataFrame:
    """The chosen documents: source, doc_id, repeats (most uses of one piece of it), tokens taken."""
    piece = mixture.groupBy("source", "doc_id", "start").agg(F.count(F.lit(1)).alias("uses"), F.sum("size").alias("size"))
    return piece.groupBy("source", "doc_id").agg(F.max("uses").alias("repeats"), F.sum("size").alias("n_tokens"))


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target_share, max_repeats, tokens taken, most repeats and actual share.

    Sources without tokens show 0; over an empty mixture every actual share is null.
    """
    taken = document_uses(mixture).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    out = targets.join(taken, "source", "left").na.fill(0, ["n_tokens", "n_docs", "most_repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # over the targets, a row per source
    return out.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total))
