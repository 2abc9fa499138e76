"""Group keys: intersectional labels, group sizes and the least size a group must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.session import broadcast_if_small, stage

SEPARATOR = "||"


def columns_of(arg: str | list[str]) -> list[str]:
    """Column names of a list or a text with commas, without blanks around them."""
    parts = [arg] if isinstance(arg, str) else list(arg)
    return [c.strip() for p in parts for c in p.split(",") if c.strip()]


def require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def without_nan(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col


def finite(df: DataFrame, c: str) -> Column:
    """The column as a double; NaN and infinities are missing, they have no place in a mean."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def label(df: DataFrame, cols: str | list[str], nan_policy: str = "exclude") -> Column:
    """The group of a row as text. Missing attributes: 'exclude' makes the label NULL, 'include' writes NaN for them."""
    if nan_policy not in ("exclude", "include"):
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    cols = columns_of(cols)
    require(df, cols)
    parts = [without_nan(df, c).cast("string") for c in cols]
    if nan_policy == "include":
        parts = [F.coalesce(p, F.lit("NaN")) for p in parts]
    if len(parts) == 1:
        return parts[0]
    # concat is NULL if one part is, concat_ws would skip it
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(SEPARATOR)] if i else []) + [p]])


def group_sizes(df: DataFrame, group: Column | str) -> DataFrame:
    """(group, n) without NULL groups."""
    g = F.col(group) if isinstance(group, str) else group
    return df.select(g.alias("group")).where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n"))


def min_group_mask(df: DataFrame, group: Column, least: int, out: str = "kept") -> DataFrame:
    """Each row with whether its group has the least size; NULL is a group here. Sizes are counted first and joined, so no task holds a group."""
    n = df.groupBy(group.alias("g__")).agg(F.count("*").alias("n__")).select("g__", (F.col("n__") >= least).alias(out))
    n = stage(n)
    return df.join(broadcast_if_small(n, n.count()), group.eqNullSafe(F.col("g__"))).drop("g__")
