"""Global ranks without a global window: a range partitioning, counted partitions, and ranks within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import cut


def global_rank(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds ``name``, the rank from 1 of every row in ``order`` (which must not tie). Rows are range-partitioned, so each
    task ranks its own range, offset by the sizes of the ranges before it; only one number for each range is combined."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(before), "_range").withColumn(name, (within + F.col("_before")).cast("bigint")).drop("_range", "_before")


def min_max(rows: DataFrame, value: str, usable: Column, low: float, high: float, name: str = "normalized") -> DataFrame:
    """Adds ``name``: the value scaled to [low, high] between the least and the largest usable value; others get 0, and all
    get ``high`` where there is but one value. The bounds are two numbers of one aggregation, not a window over the table."""
    least, most = rows.where(usable).agg(F.min(value), F.max(value)).first()
    if least is None or least == most:
        return rows.withColumn(name, F.when(usable & F.col(value).isNotNull(), float(high)).otherwise(0.0))
    scaled = F.round(low + (high - low) * (F.col(value) - least) / (most - least), 2)
    out = F.when(usable, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), scaled)))
    return rows.withColumn(name, F.coalesce(out, F.lit(0.0)))
