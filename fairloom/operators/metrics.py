"""Group-fairness metrics from one grouped aggregate.

group_stats counts every group once; each metric, effect size and interval is a small function of it. Rows with a missing group, prediction or label
(NULL, NaN or infinite) are left out. A metric needs two groups of at least min_group_size rows, else it is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.functions.scalar import cohens_d
from fairloom.operators.grouping import finite, label, require, without_nan
from fairloom.session import stage

BACKENDS = ("auto", "spark")


@dataclass
class MetricResult:
    metric: str
    value: float | None
    ci: tuple[float, float] | None = None
    effect_size: float | None = None
    n_per_group: dict[str, int] = field(default_factory=dict)


_STATS = ("n", "rate", "n_pos", "n_neg", "tpr", "fpr", "mae", "mae_var")


def group_stats_of(df: DataFrame, sensitive: str | list[str], outcomes: dict[str, tuple[str, str | None]], min_group_size: int = 30, nan_policy: str = "exclude") -> dict[str, DataFrame]:
    """group_stats for several outcomes {name: (y_pred, y_true)} from one pass; the groups' counts are written once, and each table reads them."""
    r = [label(df, sensitive, nan_policy).alias("grp")]
    for i, (yp, yt) in enumerate(outcomes.values()):
        require(df, [c for c in (yp, yt) if c])
        r += [finite(df, yp).alias(f"p{i}"), (finite(df, yt) if yt else F.lit(0.0)).alias(f"t{i}")]
    aggs = []
    for i in range(len(outcomes)):
        ok = F.col(f"p{i}").isNotNull() & F.col(f"t{i}").isNotNull()
        aggs += [x.alias(f"{k}{i}") for k, x in zip(_STATS, _sums(F.when(ok, F.col(f"p{i}")), F.when(ok, F.col(f"t{i}"))))]
    g = stage(df.select(*r).where("grp is not null").groupBy("grp").agg(*aggs))
    return {name: g.select("grp", *[F.col(f"{k}{i}").alias(k) for k in _STATS]).where(F.col("n") >= max(min_group_size, 1)) for i, name in enumerate(outcomes)}


def _sums(yp: Column, yt: Column) -> list[Column]:
    pos, neg, err = yt == 1, yt == 0, F.abs(yt - yp)
    return [F.count(yp), F.avg(yp), F.count(F.when(pos, 1)), F.count(F.when(neg, 1)), F.avg(F.when(pos, yp)), F.avg(F.when(neg, yp)), F.avg(err), F.var_samp(err)]


def group_stats(df: DataFrame, sensitive: str | list[str], y_pred: str, y_true: str | None = None, min_group_size: int = 30, nan_policy: str = "exclude") -> DataFrame:
    """(grp, n, rate, n_pos, n_neg, tpr, fpr, mae, mae_var): one row per group of the least size."""
    require(df, [y_pred] + ([y_true] if y_true else []))
    yt = finite(df, y_true) if y_true else F.lit(0.0)
    r = df.select(label(df, sensitive, nan_policy).alias("grp"), finite(df, y_pred).alias("yp"), yt.alias("yt")).dropna()
    g = r.groupBy("grp").agg(*[x.alias(k) for k, x in zip(_STATS, _sums(F.col("yp"), F.col("yt")))])
    return g.where(F.col("n") >= min_group_size)


def _gap(c: str):
    return F.when(F.count(c) >= 2, F.max(c) - F.min(c))


def _ratio(c: str):
    positive = F.when(F.col(c) > 0, F.col(c))
    return F.when(F.count(positive) >= 2, F.try_divide(F.max(positive), F.min(positive)))


def dpd(stats: DataFrame, *more: Column) -> DataFrame:
    """(value, effect_size, n_groups, more...): largest minus least rate; the effect is their ratio, NULL if the least is 0. more: further aggregates."""
    return stats.agg(_gap("rate").alias("value"), F.when(F.count("rate") >= 2, F.when(F.min("rate") != 0, F.max("rate") / F.min("rate"))).alias("effect_size"), F.count("*").alias("n_groups"), *more)


def eod(stats: DataFrame, policy: str = "finite_max", *more: Column) -> DataFrame:
    """The larger of the gaps of true and of false positive rates; 'strict' is NULL if one of them is. Effect: the largest ratio of positive rates."""
    if policy not in ("finite_max", "strict"):
        raise ValueError(f"unknown policy {policy!r}")
    a = stats.agg(_gap("tpr").alias("t"), _gap("fpr").alias("f"), F.greatest(_ratio("tpr"), _ratio("fpr")).alias("effect_size"), F.count("*").alias("n_groups"), *more)
    value = F.greatest("t", "f")
    return a.withColumn("value", F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), value) if policy == "strict" else value).drop("t", "f")


def mae_parity(stats: DataFrame, *more: Column) -> DataFrame:
    """Largest minus least mean absolute error; effect: Cohen's d of the errors of the two groups (ties: first name)."""
    s = F.struct("n", "mae", "mae_var")
    # both as minima, so that the first name wins ties
    hi, lo = F.min_by(s, F.struct(-F.col("mae"), F.col("grp"))), F.min_by(s, F.struct("mae", "grp"))
    a = stats.agg(_gap("mae").alias("value"), hi.alias("hi"), lo.alias("lo"), F.count("*").alias("n_groups"), *more)
    d = cohens_d(F.col("hi.n"), F.col("hi.mae"), F.col("hi.mae_var"), F.col("lo.n"), F.col("lo.mae"), F.col("lo.mae_var"))
    return a.withColumn("effect_size", F.when(F.col("n_groups") >= 2, d)).drop("hi", "lo")


def group_rates(stats: DataFrame, c: str = "rate") -> DataFrame:
    return stats.select("grp", "n", c)


def rates_by_subset(df: DataFrame, attributes: list[str], y_pred: str, min_group_size: int = 30) -> DataFrame:
    """(attributes, value, n_groups): demographic parity for every non-empty subset of attributes, from one pass over the cells."""
    r = df.select(*[without_nan(df, a).cast("string").alias(a) for a in attributes], finite(df, y_pred).alias("yp__")).dropna()
    cells = r.cube(*attributes).agg(F.grouping_id().alias("id__"), F.count("*").alias("n"), F.avg("yp__").alias("rate"))
    used = F.concat_ws("||", *[F.when(F.col("id__").bitwiseAND(1 << (len(attributes) - 1 - i)) == 0, F.lit(a)) for i, a in enumerate(attributes)])
    c = cells.where((F.col("n") >= min_group_size)).withColumn("attributes", used).where("attributes <> ''")
    return c.groupBy("attributes").agg(_gap("rate").alias("value"), F.count("*").alias("n_groups"))


class FairnessAnalyzer:
    """The metrics over a table's columns. Results are one-row DataFrames; collect() makes a MetricResult of one."""

    def __init__(self, min_group_size: int = 30, nan_policy: str = "exclude", backend: str | None = None, eod_policy: str = "finite_max"):
        if backend not in (None, *BACKENDS):
            raise RuntimeError(f"backend {backend!r} is not available; use one of {BACKENDS}")
        self.min_group_size, self.nan_policy, self.eod_policy = min_group_size, nan_policy, eod_policy

    def _run(self, name, df, sensitive, y_pred, y_true, with_ci, ci_level, ci_method, with_effect_size, draws, seed):
        from fairloom.functions.bootstrap import metric_interval

        s = group_stats(df, sensitive, y_pred, y_true, self.min_group_size, self.nan_policy)
        sizes = F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("n_per_group")
        one = eod(s, self.eod_policy, sizes) if name == "equalized_odds_difference" else (dpd if name == "demographic_parity_difference" else mae_parity)(s, sizes)
        ci = metric_interval(name, df, sensitive, y_pred, y_true, self.min_group_size, self.nan_policy, ci_level, ci_method, draws, seed) if with_ci else None
        bounds = F.struct(F.lit(ci[0]).cast("double").alias("lo"), F.lit(ci[1]).cast("double").alias("hi")) if ci else F.lit(None).cast("struct<lo:double,hi:double>")
        return one.select(F.lit(name).alias("metric"), "value", bounds.alias("ci"), (F.col("effect_size") if with_effect_size else F.lit(None).cast("double")).alias("effect_size"), "n_per_group")

    def demographic_parity_difference(self, df: DataFrame, *, y_pred: str, sensitive: str | list[str], with_ci: bool = False, ci_level: float = 0.95, ci_method: str = "percentile", with_effect_size: bool = False, draws: int = 2000, seed: int = 42) -> DataFrame:
        return self._run("demographic_parity_difference", df, sensitive, y_pred, None, with_ci, ci_level, ci_method, with_effect_size, draws, seed)

    def equalized_odds_difference(self, df: DataFrame, *, y_true: str, y_pred: str, sensitive: str | list[str], with_ci: bool = False, ci_level: float = 0.95, ci_method: str = "percentile", with_effect_size: bool = False, draws: int = 2000, seed: int = 42) -> DataFrame:
        return self._run("equalized_odds_difference", df, sensitive, y_pred, y_true, with_ci, ci_level, ci_method, with_effect_size, draws, seed)

    def mae_parity_difference(self, df: DataFrame, *, y_true: str, y_pred: str, sensitive: str | list[str], with_ci: bool = False, ci_level: float = 0.95, ci_method: str = "percentile", with_effect_size: bool = False, draws: int = 2000, seed: int = 42) -> DataFrame:
        return self._run("mae_parity_difference", df, sensitive, y_pred, y_true, with_ci, ci_level, ci_method, with_effect_size, draws, seed)

    @staticmethod
    def collect(result: DataFrame) -> MetricResult:
        r = result.first()
        return MetricResult(r["metric"], r["value"], tuple(r["ci"]) if r["ci"] else None, r["effect_size"], dict(r["n_per_group"] or {}))
