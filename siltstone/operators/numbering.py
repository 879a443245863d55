"""Numbering of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import write_read


def numbered(rows: DataFrame, order: list[str | Column], to: str) -> DataFrame:
    """rows with the column `to`: 1.. in the order given, which should be total.

    Sorted range partitions are numbered by their rows' places; only a count per partition is summed up.
    The numbered partitions are written down: drawn a second time, their bounds could differ. Drawing the
    bounds reads rows twice, so what is dear to compute is best written down before.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Number of the partition in the upper bits, place in the partition in the lower 33.
    place = {"_p": F.shiftright("_m", 33), "_n": F.col("_m").bitwiseAND((1 << 33) - 1) + 1}
    inner = write_read(sorted_.withColumn("_m", F.monotonically_increasing_id()), "numbered").withColumns(place)
    sums = inner.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # One row per partition.
    base = sums.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(base.select("_p", "_base"), "_p").withColumn(to, F.col("_n") + F.col("_base")).drop("_m", "_p", "_n", "_base")
