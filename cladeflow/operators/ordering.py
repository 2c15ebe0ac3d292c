"""Running totals over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.common import checkpoint


def _ranges(df: DataFrame, order: str) -> DataFrame:
    """Range-partition by a unique key and freeze the layout: later steps rely on it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))


def _carry(ranged: DataFrame, total: Column, combine: Column) -> DataFrame:
    """One row per range: what the other ranges contribute to it."""
    return ranged.groupBy("_part").agg(total.alias("_t")).withColumn("_carry", combine).drop("_t")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to this one in the order of the unique key ``order``.

    Ranges add up locally; only one total per range meets in a single task.
    """
    ranged = _ranges(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(ranged, F.sum(value), F.coalesce(F.sum("_t").over(before), F.lit(0)))
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(carry), "_part")
            .withColumn(name, F.sum(value).over(own) + F.col("_carry")).drop("_part", "_carry"))


def reverse_running_min(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Minimum of ``value`` over this row and all later ones in the order of the unique key."""
    ranged = _ranges(df, order)
    # a frame that ends at "following" is re-read for every row: run backwards instead
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carry(ranged, F.min(value), F.min("_t").over(after))
    own = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(carry), "_part")
            .withColumn(name, F.least(F.min(value).over(own), "_carry")).drop("_part", "_carry"))
