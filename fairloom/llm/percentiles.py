"""Problem 4: percentiles per group by radix selection, exact or with a known error, and mergeable.

Values become order-preserving 64-bit integers. A state is the histogram of their leading bits per group, with the least and greatest value of every
bucket; states of loads, days or partitions merge by adding. Percentiles read from a state are bounded by their bucket's ends; the exact ones
follow only the buckets that hold a target rank, digit by digit, until each holds a single value. All counting has map-side partial sums, so a group
with a third of all rows is no burden, and a group never has more buckets than a digit has values.

The p-th percentile of n values is the value of rank ceil(p * n), at least 1 (lower, no interpolation). p is given in basis points.

Defined results: NULL and NaN are missing and not counted; -0.0 equals 0.0; infinities are values; a NULL group is a group of its own; groups without
values and empty tables give no rows; ties and repeated rows count each. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.functions.ordered import from_ordered_long, with_ordered_long
from fairloom.operators.selection import first_targets, next_targets, same_keys
from fairloom.session import broadcast_if_small, stage

DIGITS = (20, 16, 14, 14)



def percentile_state(df: DataFrame, by: list[str], value: str, bits: int = 20) -> DataFrame:
    """(by, bucket, n, lo, hi): per group and leading bits, the number of values, the least and the greatest."""
    k = with_ordered_long(df.select(*by, F.col(value).alias("v__")), "v__", "k__")
    return k.groupBy(*by, F.shiftright("k__", 64 - bits).alias("bucket")).agg(F.count("*").alias("n"), from_ordered_long(F.min("k__")).alias("lo"), from_ordered_long(F.max("k__")).alias("hi"))


def merge_states(state: DataFrame, by: list[str]) -> DataFrame:
    """The states of one or more sources as one, by fewer columns if wanted (all loads of a group, say)."""
    return state.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def percentiles_of_state(state: DataFrame, by: list[str], points: list[int]) -> DataFrame:
    """(by, p_bp, n, lower, upper): the percentile lies between lower and upper, both of them values that occur."""
    b = first_targets(state.withColumnRenamed("n", "c__"), by, "bucket", points)
    return b.select(*by, F.explode("t__").alias("t"), "n__", "lo", "hi").select(*by, F.col("t.p").alias("p_bp"), F.col("n__").alias("n"), F.col("lo").alias("lower"), F.col("hi").alias("upper"))


def radix_percentiles(df: DataFrame, by: list[str], value: str, points: list[int], digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """(by, p_bp, n, value): the exact percentiles. One pass over the data for each digit that is needed, the later ones only for open buckets."""
    if sum(digits) != 64:
        raise ValueError("digits must add up to 64 bits")
    keys = [f"g{i}__" for i in range(len(by))]
    rows = with_ordered_long(df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("v__")), "v__", "k__")
    agg = [F.count("*").alias("c__"), F.min("k__").alias("lo__"), F.max("k__").alias("hi__")]
    left = 64 - digits[0]
    open_ = stage(first_targets(rows.groupBy(*keys, F.shiftright("k__", left).alias("d__")).agg(*agg), keys, "d__", points))
    done = []
    for width in digits[1:]:
        done.append(open_.where("lo__ = hi__"))
        todo = open_.where("lo__ < hi__").select(*keys, F.col("d__").alias("e__"), "t__", "n__")
        n = todo.count()
        if not n:
            break
        # rows of open buckets only; the next digit's histogram meets the targets again when it is small
        marks = broadcast_if_small(todo.select(*[F.col(k).alias(f"m_{k}") for k in [*keys, "e__"]]), n)
        r = rows.withColumn("e__", F.shiftright("k__", left))
        left -= width
        # marks are distinct; a semi join would be pushed below r's projections and compute k__ again
        hist = r.join(marks, same_keys([*keys, "e__"])).groupBy(*keys, "e__", F.shiftright("k__", left).alias("d__")).agg(*agg)
        t = todo.select(*[F.col(k).alias(f"m_{k}") for k in [*keys, "e__"]], "t__", "n__")
        open_ = stage(next_targets(hist.join(t, same_keys([*keys, "e__"])), [*keys, "e__"], "d__").select(*keys, "d__", "c__", "lo__", "hi__", "n__", "t__"))
    else:
        done.append(open_)
    out = reduce(DataFrame.unionByName, [x.select(*keys, "lo__", "n__", "t__") for x in done])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.explode("t__").alias("t"), "n__", "lo__").select(*by, F.col("t.p").alias("p_bp"), F.col("n__").alias("n"), from_ordered_long(F.col("lo__")).alias("value"))
