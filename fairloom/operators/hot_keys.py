"""Problem 5: per-key counts, rates and value statistics when a few keys hold most rows.

Rows are counted into (key, value bucket) cells with map-side partial sums, so a hot key is spread over the cells of its values and no task sees its
rows. All statistics roll up from these cells. Percentiles are exact: the cell that holds a wanted rank becomes an interval between the least and
greatest value in it, the data are counted again into finer steps of the open intervals only, and so on until every interval holds one value.

Defined results: NULL keys are a key of their own; keys that differ only in case or blanks differ; NULL and NaN values are missing; infinities count
as values but not in mean and deviation; a key without values has NULL statistics; ties and repeated rows count each; an empty table gives no rows.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.functions.ordered import from_ordered_long, with_ordered_long
from fairloom.operators.selection import first_targets, next_targets, same_keys
from fairloom.session import broadcast_if_small, stage

#: Leading bits of the first cells (sign, exponent, 8 bits of fraction) and steps of each refinement.
CELL_BITS, STEPS = 20, 4096


def key_statistics(df: DataFrame, key: str, value: str, rates: list[str] = (), points: list[int] = (2500, 5000, 7500), steps: int = STEPS) -> DataFrame:
    """(key, n_rows, n_values, mean, stddev, least, greatest, rate_<column>..., p<point>...), one row per key."""
    shift = 64 - CELL_BITS
    rate_cols = [f"r{i}__" for i in range(len(rates))]
    rows = df.select(F.col(f"`{key}`").alias("key__"), F.col(f"`{value}`").cast("double").alias("v__"), *[F.col(f"`{c}`").cast("double").alias(k) for c, k in zip(rates, rate_cols)])
    rows = with_ordered_long(rows, "v__", "k__", keep_missing=True)
    finite = F.when(F.col("k__").isNotNull() & (F.abs("v__") < float("inf")), F.col("v__"))
    sums = [F.sum(finite).alias("s1__"), F.sum(finite * finite).alias("s2__"), F.count(finite).alias("f__")]
    for c in rate_cols:
        sums += [F.sum(c).alias(f"{c}s"), F.count(c).alias(f"{c}n")]
    cells = stage(rows.groupBy("key__", F.shiftright("k__", shift).alias("b__")).agg(F.count("*").alias("c__"), F.min("k__").alias("lo__"), F.max("k__").alias("hi__"), *sums))

    total = [F.sum("c__").alias("n_rows"), F.sum(F.when(F.col("b__").isNotNull(), F.col("c__")).otherwise(0)).alias("n_values"), F.min("lo__").alias("lo__"), F.max("hi__").alias("hi__")]
    total += [F.sum(c).alias(c) for c in ("s1__", "s2__", "f__")] + [F.sum(f"{c}{x}").alias(f"{c}{x}") for c in rate_cols for x in "sn"]
    mean = F.try_divide("s1__", "f__")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("s2__") - F.col("s1__") * mean, F.col("f__") - 1), F.lit(0.0)))
    stats = cells.groupBy("key__").agg(*total).select(
        "key__", "n_rows", "n_values", mean.alias("mean"), F.when(F.col("f__") > 1, spread).alias("stddev"), from_ordered_long(F.col("lo__")).alias("least"), from_ordered_long(F.col("hi__")).alias("greatest"),
        *[F.try_divide(f"{c}s", f"{c}n").alias(f"rate_{name}") for c, name in zip(rate_cols, rates)],
    )

    if points:
        # coalesce keeps Catalyst from pushing "k__ is not null" below the projections that compute it
        inside = F.coalesce(F.col("k__").between(F.col("lo__"), F.col("hi__")), F.lit(False))
        open_ = first_targets(cells.where("b__ is not null").select("key__", "b__", "c__", "lo__", "hi__"), ["key__"], "b__", list(points)).select("key__", "b__", "lo__", "hi__", "t__")
        open_, done = stage(open_), None
        while True:
            part = open_.where("lo__ = hi__").select("key__", "lo__", "t__")
            done = part if done is None else done.unionByName(part)
            todo = open_.where("lo__ < hi__")
            n = todo.count()
            if not n:
                break
            marks = broadcast_if_small(todo.select(F.col("key__").alias("m_key__"), F.col("b__").alias("m_b__"), "lo__", "hi__"), n)
            fine = rows.select("key__", "k__", F.shiftright("k__", shift).alias("b__")).join(marks, same_keys(["key__", "b__"]) & inside)
            step = F.expr(f"(k__ - lo__) div ((hi__ - lo__) div {steps} + 1)")
            fine = fine.groupBy("key__", "b__", F.col("lo__").alias("from__"), step.alias("d__")).agg(F.count("*").alias("c__"), F.min("k__").alias("lo__"), F.max("k__").alias("hi__"))
            old = todo.select(F.col("key__").alias("m_key__"), F.col("lo__").alias("m_from__"), "t__")
            open_ = stage(next_targets(fine.join(old, same_keys(["key__", "from__"])), ["key__", "from__"], "d__").select("key__", "b__", "lo__", "hi__", "t__"))
        each = done.select("key__", F.explode("t__").alias("t"), from_ordered_long(F.col("lo__")).alias("v__"))
        wide = each.groupBy(F.col("key__").alias("m_key__")).agg(*[F.max(F.when(F.col("t.p") == p, F.col("v__"))).alias(f"p{p}") for p in points])
        stats = stats.join(wide, same_keys(["key__"]), "left").drop("m_key__")
    return stats.withColumnRenamed("key__", key)


def hot_keys(statistics: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """The non-NULL keys of key_statistics that hold more than percent of the rows with a key, with their share."""
    s = stage(statistics.where(F.col(f"`{key}`").isNotNull()))
    total = s.agg(F.sum("n_rows")).first()[0] or 0
    return s.where(F.col("n_rows") * 100 > F.lit(total) * percent).withColumn("share", F.col("n_rows") / F.lit(max(total, 1)))
