"""Running sums over a total order without a single task: range partitions, their sums, and windows within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.session import stage


def running_sum(df: DataFrame, order: list[str], count: str, out: str) -> DataFrame:
    """df with out: the sum of count over all rows before this one in the order, which must be unique. Partitions' sums go through the driver."""
    # the partition number is written down with the rows: range bounds are sampled, and another run could draw others
    parts = stage(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()))
    sums = dict(parts.groupBy("part__").agg(F.sum(count)).collect())
    before, total = [], 0
    for p in sorted(sums):
        before += [F.lit(p), F.lit(total)]
        total += sums[p] or 0
    w = Window.partitionBy("part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.create_map(*before), F.col("part__")) if before else F.lit(0)
    return parts.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)) + start.cast("long")).drop("part__")
