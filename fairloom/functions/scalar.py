"""Scalar expressions: logits, clipping, rounding, losses, effect sizes and multiple-test corrections on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Of an array of logits, shifted by its maximum."""
    e = F.transform(xs, lambda v: F.exp(v - F.array_max(xs)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def binarize(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def to_number(x: Column) -> Column:
    """A double, NULL where the value is none; NaN is NULL too."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def bce_with_logits(x: Column, y: Column, pos_weight: float | None = None) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    log_one_plus = F.log1p(F.exp(-F.abs(x)))
    if pos_weight is None:
        return F.greatest(x, F.lit(0.0)) - x * y + log_one_plus
    # -w*y*log(s(x)) - (1-y)*log(1-s(x))
    return pos_weight * y * (log_one_plus + F.greatest(-x, F.lit(0.0))) + (1 - y) * (log_one_plus + F.greatest(x, F.lit(0.0)))


def risk_ratio(p1: Column, p2: Column) -> Column:
    return F.when((p2 != 0) & ~F.isnan(p1) & ~F.isnan(p2), p1 / p2)


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """From sizes, means and sample variances; NULL below two values each or without spread."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), F.try_divide(m1 - m2, pooled))


def bonferroni(df: DataFrame, p: str, out: str = "p_bonferroni") -> DataFrame:
    """min(1, p * m) over the rows of a table of tests (one row per test: small, NULLs not counted)."""
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(F.lit(1)))))


def benjamini_hochberg(df: DataFrame, p: str, key: list[str], out: str = "p_bh") -> DataFrame:
    """The step-up adjusted p-values of a table of tests; key breaks ties, NULLs stay NULL."""
    all_ = Window.partitionBy(F.col(p).isNull())
    r = df.withColumn("i__", F.row_number().over(all_.orderBy(p, *key))).withColumn("m__", F.count(p).over(all_))
    r = r.withColumn("a__", F.col(p) * F.col("m__") / F.col("i__"))
    back = all_.orderBy(F.desc("i__")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("a__").over(back)))).drop("i__", "m__", "a__")
