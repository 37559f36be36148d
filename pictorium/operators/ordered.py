"""Running sums and slices over a whole table, without gathering its rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import checkpointed


def sum_before(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before this one in order of ``by``, which must tell rows apart.

    Rows are dealt by ranges of ``by``; a sum for each range, a row a partition, carries over to the next.
    """
    dealt = checkpointed(rows.withColumn("_value", value).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum")).withColumn("_carried", F.coalesce(before, F.lit(0))).drop("_sum")
    within = F.sum("_value").over(W.partitionBy("_part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    out = dealt.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(parts), "_part")
    return out.withColumn(name, F.col("_carried") + F.col("_within")).drop("_part", "_carried", "_within", "_value")


def sliced(items: DataFrame, by: str, size: int) -> DataFrame:
    """``items`` with ``batch``: contiguous slices of ``size`` in order of ``by``."""
    return sum_before(items, [by], F.lit(1), "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("int")).drop("_place")
