"""Write semantics on plain Parquet: idempotent append, upsert, replace, collection of the unused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.numbering import numbered
from siltstone.session import write_read


def new_rows(stage: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of stage to append: the first, by order, of every key that is not there yet.

    A row without a key conflicts with nothing and is always new.
    """
    from siltstone.functions.keys import one_per_record

    return one_per_record(stage, key, *order).join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def idempotent_append(stage: DataFrame, path: str, key: str, order: list[str]) -> int:
    """Append what is new to the table at path; returns how many rows were. A repeat appends nothing.

    One writer at a time: two at once may both append a record that neither has seen.
    """
    spark = stage.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    fresh = new_rows(stage, spark.read.schema(stage.schema).parquet(path) if there else stage.limit(0), key, order)
    from pyspark.sql import Observation

    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).select(stage.columns).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], delete_missing: bool = False) -> DataFrame:
    """The merged rows: keys, values and `change` ('insert', 'update', 'same', 'keep' or 'delete').

    Keys match null-safely. A matched row takes the incoming values; one that exists only here is kept,
    or marked 'delete'. incoming must hold a key at most once.
    """
    a = existing.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(v).alias(f"_av_{v}") for v in values], F.lit(True).alias("_a"))
    b = incoming.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(v).alias(f"_bv_{v}") for v in values], F.lit(True).alias("_b"))
    on = None
    for k in keys:
        same = F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
        on = same if on is None else on & same
    both = a.join(b, on, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_av_{v}").eqNullSafe(F.col(f"_bv_{v}"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete" if delete_missing else "keep").when(same, "same").otherwise("update")
    take = F.col("_b").isNotNull()
    return both.select(
        *(F.when(take, F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}")).alias(k) for k in keys),
        *(F.when(take, F.col(f"_bv_{v}")).otherwise(F.col(f"_av_{v}")).alias(v) for v in values),
        change.alias("change"),
    )


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that rows has some of; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def collectable(incidents: DataFrame, active: DataFrame, narrated: DataFrame, key: str = "id") -> DataFrame:
    """Incidents that are neither active nor have a narrative."""
    return incidents.join(active.select(key), key, "left_anti").join(narrated.select(key), key, "left_anti")


def guard_rebuild(narratives: DataFrame, force: bool = False) -> None:
    """Refuse a rebuild that would orphan narratives, unless forced."""
    if not force and not narratives.isEmpty():
        raise RuntimeError("narratives exist; force the rebuild to drop them")


def compare_content(stored: DataFrame, source: DataFrame, key: str, content: str) -> DataFrame:
    """(n_stored, n_source, n_missing, n_extra, n_different): both sides compared by SHA-256 of the content."""
    a = stored.select(key, F.sha2(content, 256).alias("_a"), F.lit(1).alias("_ia"))
    b = source.select(key, F.sha2(content, 256).alias("_b"), F.lit(1).alias("_ib"))
    return a.join(b, key, "full_outer").agg(
        F.count("_ia").alias("n_stored"),
        F.count("_ib").alias("n_source"),
        F.count_if(F.col("_ia").isNull()).alias("n_missing"),
        F.count_if(F.col("_ib").isNull()).alias("n_extra"),
        F.count_if(F.col("_ia").isNotNull() & F.col("_ib").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"),
    )


def upsert_incidents(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Incidents after a new run: id, the columns of found, and `change` ('insert' or 'update').

    An incident is the same where its first_seen and its set of hosts are. It keeps its id (the greatest,
    if several have the same key); new ones are numbered on from the greatest id there is, by first_seen
    and hosts. existing: id, first_seen, hosts; found: first_seen, hosts and more, a row per incident.
    """
    key = F.array_join(F.array_sort(F.coalesce("hosts", F.array().cast("array<string>"))), "\x00")
    old = existing.groupBy("first_seen", key.alias("_key")).agg(F.max("id").alias("_old"))
    rows = found.drop("id").withColumn("_key", key).alias("n").join(old.alias("o"), F.col("n.first_seen").eqNullSafe(F.col("o.first_seen")) & (F.col("n._key") == F.col("o._key")), "left").select("n.*", "_old")
    rows = write_read(rows, "incidents")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]
    new = numbered(rows.where("_old is null"), ["first_seen", "_key"], "id").withColumns({"id": F.col("id") + F.lit(last), "change": F.lit("insert")})
    kept = rows.where("_old is not null").withColumns({"id": F.col("_old"), "change": F.lit("update")})
    return kept.unionByName(new).drop("_key", "_old")


def clear_tables(spark: SparkSession, schemas: dict[str, StructType]) -> None:
    """Make tables empty that are derived anew on every run; schemas are by path. Other tables, as incidents, stay."""
    for path, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
