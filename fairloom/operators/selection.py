"""Which buckets of a histogram hold wanted ranks: the step that radix selection and interval refinement share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(point: int, n: Column | str) -> Column:
    """The rank, from 1, of the percentile at point basis points of n values: ceil(point * n / 10000), at least 1, in whole numbers."""
    return F.greatest(F.expr(f"({n} * {point} + 9999) div 10000"), F.lit(1).cast("long"))


def first_targets(hist: DataFrame, by: list[str], order: str, points: list[int]) -> DataFrame:
    """hist's rows (one per group and bucket, c__ values in it) that hold a percentile, with n__, the group's size, and t__: (p, rank in the bucket)."""
    w = Window.partitionBy(*by)
    h = hist.withColumn("n__", F.sum("c__").over(w)).withColumn("end__", F.sum("c__").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    every = F.array(*[F.struct(F.lit(p).alias("p"), (rank_of(p, "n__") - F.col("end__") + F.col("c__")).alias("r")) for p in points])
    return h.withColumn("t__", F.filter(every, _inside)).where(F.size("t__") > 0).drop("end__")


def next_targets(hist: DataFrame, by: list[str], order: str) -> DataFrame:
    """The same one level down: hist's rows carry t__ of the bucket they refine, and by names that bucket."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("end__", F.sum("c__").over(w))
    h = h.withColumn("t__", F.transform("t__", lambda t: F.struct(t["p"].alias("p"), (t["r"] - F.col("end__") + F.col("c__")).alias("r"))))
    return h.withColumn("t__", F.filter("t__", _inside)).where(F.size("t__") > 0).drop("end__")


def _inside(t: Column) -> Column:
    return (t["r"] > 0) & (t["r"] <= F.col("c__"))


def same_keys(cols: list[str], prefix: str = "m_") -> Column:
    """Null-safe equality of each column with its prefixed twin.

    Null-safe also where no NULL can occur: for a plain equality Catalyst infers a not-null filter, pushes it below the projections and computes
    their expressions a second time there.
    """
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on
