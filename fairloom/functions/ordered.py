"""Doubles as order-preserving 64-bit integers, in built-in expressions only.

The integer order is the numeric order: -inf first, inf last, -0.0 equal to 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = 0x7FF0000000000000


def with_ordered_long(df: DataFrame, value: str, out: str, keep_missing: bool = False) -> DataFrame:
    """df's rows whose value is neither NULL nor NaN, with out: its IEEE bits as a signed integer that sorts like it.

    keep_missing keeps the other rows too, with a NULL. The names x__, a__, e__, m__ and b__ must be free in df.

    Each step is a column that the next one uses more than once, so Catalyst keeps them apart and every row pays one logarithm and one power.
    """
    names = df.columns
    x = F.col(f"`{value}`").cast("double")
    there = x.isNotNull() & ~F.isnan(x)
    r = (df if keep_missing else df.where(there)).select(*[F.col(f"`{c}`") for c in names], (F.when(there, x) if keep_missing else x).alias("x__"))
    r = r.select("*", F.abs("x__").alias("a__"))
    # the exponent, kept where 2^e is a normal number; it can be one off next to a power of two
    e = F.least(F.greatest(F.coalesce(F.floor(F.log2("a__")), F.lit(-1022)), F.lit(-1022)), F.lit(1023))
    r = r.select("*", e.cast("int").alias("e__"))
    r = r.select("*", (F.col("a__") / F.pow(F.lit(2.0), F.col("e__"))).alias("m__"))
    up, down = (F.col("m__") >= 2) & (F.col("e__") < 1023), (F.col("m__") < 1) & (F.col("e__") > -1022)
    m = F.when(up, F.col("m__") / 2).when(down, F.col("m__") * 2).otherwise(F.col("m__"))
    e = F.col("e__") + F.when(up, 1).when(down, -1).otherwise(0)
    # the implicit leading 1 of m carries into the exponent; below 2^-1022 it is missing and the exponent is 0
    bits = F.when(F.col("a__") == float("inf"), F.lit(_INF)).otherwise(F.shiftleft((e + 1022).cast("long"), 52) + (m * float(1 << 52)).cast("long"))
    r = r.select(*[F.col(f"`{c}`") for c in names], "x__", bits.alias("b__"))
    return r.select(*[F.col(f"`{c}`") for c in names], F.when(F.col("x__") < 0, -F.col("b__")).otherwise(F.col("b__")).alias(out))


def from_ordered_long(k: Column) -> Column:
    """The double whose bits these are."""
    b = F.abs(k)
    e = F.shiftright(b, 52).cast("int")
    m = b.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (m / float(1 << 52) + 1.0) * F.pow(F.lit(2.0), (e - 1023))
    v = F.when(b == _INF, F.lit(float("inf"))).when(e > 0, normal).otherwise(m * 2.0**-537 * 2.0**-537)
    return F.when(k < 0, -v).otherwise(v)
