"""Association of features with attributes: contingency counts and moments of many pairs at once, and the statistics in closed form.

Pairs are rows of a long table (feature, attribute, ...), so that one shuffle serves all of them and no table is pivoted. Pairs with a missing value are
left out pair by pair. Degenerate pairs give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.operators.grouping import without_nan
from fairloom.session import stage

#: Whole numbers with at most so many values next to an attribute are categories.
FEW = 20
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PLAIN = (T.StringType, T.BooleanType, T.FloatType, T.DoubleType, T.DecimalType, *_WHOLE)


def usable(df: DataFrame, without: list[str]) -> list[str]:
    """The columns that can be features: no dates, times, binaries or nested values."""
    return [f.name for f in df.schema if isinstance(f.dataType, _PLAIN) and f.name not in without]


def contingency(df: DataFrame, features: list[str], attributes: list[str]) -> DataFrame:
    """(feature, attribute, f, a, n): counts of value pairs as text."""
    return contingency_of(df, [(f, a) for a in attributes for f in features])


def contingency_of(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The same for chosen pairs (feature, attribute), in one pass and one shuffle."""
    return _pairs(df, pairs, "string").groupBy("feature", "attribute", "f", "a").agg(F.count("*").alias("n"))


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], kind: str) -> DataFrame:
    value = lambda c: without_nan(df, c).cast(kind)
    two = [F.struct(F.lit(f).alias("feature"), F.lit(a).alias("attribute"), value(f).alias("f"), without_nan(df, a).cast("string").alias("a")) for f, a in pairs]
    return df.select(F.inline(F.array(*two))).where("f is not null and a is not null")


def chi2(counts: DataFrame) -> DataFrame:
    """(feature, attribute, n, chi2, dof, v): from non-zero cells, chi2 = n (sum O^2 / (R C) - 1) and V = sqrt(chi2 / n / (min(r, k) - 1)).

    The counts are written once; their row and column sums come from one aggregate by grouping sets."""
    pair = ["feature", "attribute"]
    counts = stage(counts)
    sums = stage(counts.groupingSets([[*map(F.col, pair), F.col("f")], [*map(F.col, pair), F.col("a")]], *map(F.col, pair), F.col("f"), F.col("a")).agg(F.sum("n").alias("m"), F.grouping("a").alias("row")))
    r, c = sums.where("row = 1").select(*pair, "f", F.col("m").alias("r")), sums.where("row = 0").select(*pair, "a", F.col("m").alias("c"))
    size = sums.groupBy(*pair).agg(F.sum("row").alias("rows"), F.sum(1 - F.col("row")).alias("cols"))
    s = counts.join(r, [*pair, "f"]).join(c, [*pair, "a"]).groupBy(*pair).agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.sum("n").alias("n")).join(size, pair)
    small = F.least("rows", "cols")
    phi = F.greatest(F.col("s") - 1, F.lit(0.0))
    ok = small >= 2
    return s.select(*pair, "n", F.when(ok, F.col("n") * phi).alias("chi2"), F.when(ok, (F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), F.when(ok, F.sqrt(phi / (small - 1))).alias("v"))


def moments(df: DataFrame, features: list[str], attributes: list[str]) -> DataFrame:
    """(feature, attribute, a, n, mean, var): of a numeric feature within each value of an attribute."""
    return _pairs(df, [(f, a) for a in attributes for f in features], "double").groupBy("feature", "attribute", "a").agg(F.count("*").alias("n"), F.avg("f").alias("mean"), F.coalesce(F.var_samp("f"), F.lit(0.0)).alias("var"))


def anova(groups: DataFrame) -> DataFrame:
    """(feature, attribute, n, f, dfb, dfw, eta2) from moments."""
    pair = ["feature", "attribute"]
    total = groups.groupBy(*pair).agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    g = groups.select(*pair, F.col("n").alias("ng"), "mean", "var").join(total, pair)
    s = g.groupBy(*pair, "n", "k").agg(F.sum(F.col("ng") * (F.col("mean") - F.col("m")) ** 2).alias("b"), F.sum((F.col("ng") - 1) * F.col("var")).alias("w"))
    ok = (F.col("k") >= 2) & (F.col("n") > F.col("k")) & (F.col("w") > 0)
    f = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    return s.select(*pair, "n", F.when(ok, f).alias("f"), (F.col("k") - 1).alias("dfb"), (F.col("n") - F.col("k")).alias("dfw"), F.when(ok, F.try_divide("b", F.col("b") + F.col("w"))).alias("eta2"))


def abs_pearson(x: Column, y: Column) -> Column:
    """As an aggregate: |r| over complete pairs; 0 for fewer than three pairs or a constant. F.corr would fail on a constant in ANSI mode."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.coalesce(F.when(F.count(x) >= 3, F.abs(r)), F.lit(0.0))


def split_kinds(df: DataFrame, features: list[str], attributes: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Counts of the categorical pairs, the features that may be categories, and those that are numbers next to some attribute.

    Text and booleans are categories, whole numbers are with at most FEW values beside an attribute, the rest is numeric. An estimate of the distinct
    values first keeps wide columns out of the counts.
    """
    kinds = {c: df.schema[c].dataType for c in features}
    whole = [c for c in features if isinstance(kinds[c], _WHOLE)]
    narrow = set()
    if whole:
        est = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(str(i)) for i, c in enumerate(whole)]).first()
        narrow = {c for i, c in enumerate(whole) if est[i] <= 2 * FEW}
    text = [c for c in features if isinstance(kinds[c], (T.StringType, T.BooleanType))]
    cats = [c for c in features if c in text or c in narrow]
    nums = [c for c in features if c not in text]
    counts = contingency(df, cats, attributes) if cats else df.sparkSession.createDataFrame([], "feature string, attribute string, f string, a string, n long")
    if narrow:
        few = counts.groupBy("feature", "attribute", "f").agg(F.lit(1)).groupBy("feature", "attribute").agg(F.count("*").alias("k")).where(F.col("feature").isin(text) | (F.col("k") <= FEW))
        counts = counts.join(few.select("feature", "attribute"), ["feature", "attribute"], "left_semi")
    return counts, cats, nums
