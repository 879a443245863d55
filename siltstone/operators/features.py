"""One row of features per entity over hundreds of event types, built in co-bucketed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import write_bucketed

DAY_US = 86_400_000_000


def feature_blocks(events: DataFrame, entity: str, kind: str, at_us: str, latest_us: Column, n_blocks: int, recent_us: int, buckets: int) -> DataFrame:
    """Every block of event types aggregated by entity: entity, _block and features, a map from type to (n, n_recent, last_us, idle_us).

    Types are spread over blocks by hash, so the blocks need no list of types. Counts by (entity, type)
    are combined map-side, so an entity with very many events is shuffled as a row per type and task;
    what follows moves those compact rows once more, by entity. The result is written partitioned by
    block and bucketed by entity.
    """
    per_type = events.groupBy(entity, kind, F.pmod(F.xxhash64(kind), F.lit(n_blocks)).alias("_block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(at_us) >= latest_us - F.lit(recent_us)).alias("n_recent"),
        F.max(at_us).alias("last_us"),
    )
    entry = F.struct(F.col(kind), F.struct("n", "n_recent", "last_us", (latest_us - F.col("last_us")).alias("idle_us")))
    rows = per_type.repartition(buckets, entity).groupBy(entity, "_block").agg(F.map_from_entries(F.collect_list(entry)).alias("features"))
    return write_bucketed(rows, "features", entity, buckets, "_block")


def entity_features(
    events: DataFrame,
    entity: str,
    kind: str,
    at_us: str,
    latest_us: int | Column | None,
    n_blocks: int = 4,
    recent_us: int = DAY_US,
    entities: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per entity: total, n_types, last_us and the block maps block_0..block_{n-1}.

    entities is the complete entity table (default: every entity with an event); one without events
    gets a total of 0 and null blocks. Rows with a null entity, type or time count nowhere. A row's
    width is bounded by the number of types, not of events.

    The events are read and shuffled once. The blocks and the entity table are bucketed alike by
    entity, so each join reads its block's buckets and needs no shuffle; buckets defaults to the
    number of shuffle partitions.
    """
    whole = events.select(entity, kind, at_us).where(F.col(entity).isNotNull() & F.col(kind).isNotNull() & F.col(at_us).isNotNull())
    buckets = buckets or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    latest = latest_us if isinstance(latest_us, Column) else F.lit(latest_us).cast("bigint")
    blocks = feature_blocks(whole, entity, kind, at_us, latest, n_blocks, recent_us, buckets)
    if entities is None:
        out = blocks.select(entity).distinct()
    else:
        named = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
        out = write_bucketed(named.repartition(buckets, entity), "entities", entity, buckets)
    for b in range(n_blocks):
        out = out.join(blocks.where(F.col("_block") == b).select(entity, F.col("features").alias(f"block_{b}")), entity, "left")
    values = F.flatten(F.array(*(F.coalesce(F.map_values(f"block_{b}"), F.array()) for b in range(n_blocks))))
    out = out.withColumn("_values", values)
    return out.select(
        entity,
        F.aggregate("_values", F.lit(0).cast("bigint"), lambda acc, v: acc + v["n"]).alias("total"),
        F.size("_values").cast("bigint").alias("n_types"),
        F.array_max(F.transform("_values", lambda v: v["last_us"])).alias("last_us"),
        *(f"block_{b}" for b in range(n_blocks)),
    )


def features_long(features: DataFrame, entity: str, kind: str) -> DataFrame:
    """The feature rows in long form: a row per entity and type that occurs."""
    blocks = [c for c in features.columns if c.startswith("block_")]
    entries = F.flatten(F.array(*(F.coalesce(F.map_entries(b), F.array()) for b in blocks)))
    return features.select(entity, "total", F.explode(entries).alias("_e")).select(
        entity,
        F.col("_e.key").alias(kind),
        F.col("_e.value.n").alias("n"),
        F.col("_e.value.n_recent").alias("n_recent"),
        F.col("_e.value.last_us").alias("last_us"),
        F.col("_e.value.idle_us").alias("idle_us"),
        "total",
    )
