"""Mitigations as pyspark.ml stages: instance weights, reweighing, repair of numeric features, and dropping proxies.

What fit learns is a small table (groups, cells, scores) or, for the repair, the pool of values; transform joins it. Weights are a column.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.functions.scalar import clip, to_number
from fairloom.operators.association import abs_pearson, chi2, contingency_of
from fairloom.operators.grouping import require, without_nan
from fairloom.operators.prefix import running_sum
from fairloom.operators.selection import same_keys
from fairloom.session import broadcast_if_small, stage


#: Places of the pool that one task sorts at most.
PLACES = 500_000


def _text(df: DataFrame, c: str) -> Column:
    return without_nan(df, c).cast("string")


class WeightModel(Model):
    """Adds a weight by the row's cell of attributes."""

    def __init__(self, attributes: list[str], cells: DataFrame, n_cells: int, out: str):
        super().__init__()
        self.attributes, self.cells, self.n_cells, self.out = attributes, cells, n_cells, out

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.attributes:
            return df.withColumn(self.out, F.lit(1.0))
        keys = [f"k{i}__" for i in range(len(self.attributes))]
        x = df.withColumns({k: _text(df, a) for k, a in zip(keys, self.attributes)})
        cells = self.cells.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("w__").alias(self.out))
        return x.join(broadcast_if_small(cells, self.n_cells), same_keys(keys), "left").withColumn(self.out, F.coalesce(self.out, F.lit(1.0))).drop(*keys, *[f"m_{k}" for k in keys])


class _Weights(Estimator):
    def _cells(self, df: DataFrame, attributes: list[str]) -> DataFrame:
        keys = [f"k{i}__" for i in range(len(attributes))]
        return stage(df.select(*[_text(df, a).alias(k) for k, a in zip(keys, attributes)]).groupBy(*keys).agg(F.count("*").alias("n__")))

    def _factor(self, cells: DataFrame, key: str, benchmark: dict | None) -> DataFrame:
        """(key, f__) of one attribute."""
        raise NotImplementedError

    def _model(self, df: DataFrame, attributes: list[str], after, out: str) -> WeightModel:
        if not attributes:
            return WeightModel([], None, 0, out)
        cells = self._cells(df, attributes)
        w = cells
        product = F.lit(1.0)
        for i, a in enumerate(attributes):
            f = self._factor(cells, f"k{i}__", (self.benchmarks or {}).get(a)).select(F.col(f"k{i}__").alias(f"m_k{i}__"), F.col("f__").alias(f"f{i}__"))
            w = w.join(f, same_keys([f"k{i}__"]), "left").drop(f"m_k{i}__")
            product = product * F.coalesce(f"f{i}__", F.lit(1.0))
        w = w.withColumn("w__", after(product))
        total = w.agg(F.sum(F.col("n__") * F.col("w__")), F.sum("n__"), F.count("*")).first()
        mean = total[0] / total[1] if total[1] and total[0] else 1.0
        keys = [f"k{i}__" for i in range(len(attributes))]
        return WeightModel(attributes, stage(w.select(*keys, (F.col("w__") / mean).alias("w__"))), total[2], out)


class InstanceReweighting(_Weights):
    """Per attribute expected over observed count, clipped per attribute; the product over attributes is scaled to mean 1.

    Expected counts are the benchmark's share, or an equal one, rounded half to even, and at least min_count. NULL groups have factor 1; attributes that
    are no columns are skipped.
    """

    def __init__(self, sensitive: list[str], benchmarks: dict | None = None, max_weight: float = 10.0, min_count: int = 1, out: str = "sample_weight"):
        super().__init__()
        self.sensitive, self.benchmarks, self.max_weight, self.min_count, self.out = sensitive, benchmarks, max_weight, min_count, out

    def _factor(self, cells: DataFrame, key: str, benchmark: dict | None) -> DataFrame:
        g = cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n__").alias("o__"))
        total, k = g.agg(F.sum("o__"), F.count("*")).first()
        total = total or 0
        share = F.lit(total / max(k, 1))
        if benchmark:
            share = F.coalesce(F.try_element_at(F.create_map(*[x for a, v in benchmark.items() for x in (F.lit(str(a)), F.lit(float(v)))]), F.col(key)), F.lit(0.0)) * total
        expected = F.greatest(F.lit(float(self.min_count)), F.rint(share))
        return g.select(key, clip(expected / F.col("o__"), 1 / self.max_weight, self.max_weight).alias("f__"))

    def _fit(self, df: DataFrame) -> WeightModel:
        return self._model(df, [a for a in self.sensitive if a in df.columns], lambda w: w, self.out)


class ReweighingTransformer(_Weights):
    """Target over observed share per attribute, the product clipped once and scaled to mean 1.

    Targets are the benchmark scaled to sum 1 (uniform if its sum is 0) or uniform; groups without a target get next to none. NULL is a group.
    """

    def __init__(self, sensitive: list[str], benchmarks: dict | None = None, clip: float | None = 10.0, out: str = "sample_weight"):
        super().__init__()
        self.sensitive, self.benchmarks, self.clip, self.out = sensitive, benchmarks, clip, out

    def _factor(self, cells: DataFrame, key: str, benchmark: dict | None) -> DataFrame:
        g = cells.groupBy(key).agg(F.sum("n__").alias("o__"))
        total, k = g.agg(F.sum("o__"), F.count("*")).first()
        whole = sum(benchmark.values()) if benchmark else 0
        target = F.coalesce(F.try_element_at(F.create_map(*[x for a, v in benchmark.items() for x in (F.lit(str(a)), F.lit(float(v) / whole))]), F.col(key)), F.lit(0.0)) if whole else F.lit(1.0 / max(k, 1))
        return g.select(key, F.greatest(F.lit(1e-9), target / (F.col("o__") / F.lit(total))).alias("f__"))

    def _fit(self, df: DataFrame) -> WeightModel:
        require(df, self.sensitive)
        return self._model(df, self.sensitive, lambda w: F.least(w, F.lit(float(self.clip))) if self.clip else w, self.out)


def _pool(df: DataFrame, feature: str) -> tuple[DataFrame, int]:
    """(v, c, start): the distinct values in order, their counts, and how many values are less."""
    v = df.select(to_number(without_nan(df, feature)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    p = stage(running_sum(v, ["v"], "c", "start"))
    return p, p.agg(F.sum("c")).first()[0] or 0


class RepairModel(Model):
    def __init__(self, sensitive: str, pools: dict[str, tuple[DataFrame, int]], repair_level: float, min_group_size: int):
        super().__init__()
        self.sensitive, self.pools, self.repair_level, self.min_group_size = sensitive, pools, repair_level, min_group_size

    def _transform(self, df: DataFrame) -> DataFrame:
        for f, (pool, n) in self.pools.items():
            df = self._repair(df, f, pool, n) if n else df.withColumn(f, to_number(without_nan(df, f)))
        return df

    def _repair(self, df: DataFrame, feature: str, pool: DataFrame, n: int) -> DataFrame:
        x = df.withColumn("g__", _text(df, self.sensitive)).withColumn("x__", to_number(without_nan(df, feature)))
        size = x.where("g__ is not null").groupBy("g__").agg(F.count("*").alias("size__")).where(F.col("size__") >= self.min_group_size)
        cells = x.where("x__ is not null and g__ is not null").groupBy("g__", "x__").agg(F.count("*").alias("c__")).join(size, "g__")
        # ranks in all groups at once: running sums over (group, value) less the group's first one
        r = running_sum(cells, ["g__", "x__"], "c__", "at__")
        r = stage(r.join(r.groupBy("g__").agg(F.min("at__").alias("first__")), "g__"))
        rank = F.col("at__") - F.col("first__") + (F.col("c__") + 1) / 2
        place = (rank - 0.5) * n / F.col("size__") - 0.5
        r = r.select("g__", "x__", F.least(F.greatest(place, F.lit(0.0)), F.lit(float(n - 1))).alias("i__"))
        r = r.withColumn("lo__", F.floor("i__")).withColumn("hi__", F.least(F.col("lo__") + 1, F.lit(n - 1)))
        at = self._values_at(r.select("lo__").unionByName(r.select(F.col("hi__").alias("lo__"))).distinct(), pool, n)
        r = r.join(at.select(F.col("p__").alias("lo__"), F.col("v").alias("a__")), "lo__").join(at.select(F.col("p__").alias("hi__"), F.col("v").alias("b__")), "hi__")
        r = r.select(F.col("g__").alias("m_g__"), F.col("x__").alias("m_x__"), (F.col("a__") + (F.col("i__") - F.col("lo__")) * (F.col("b__") - F.col("a__"))).alias("y__"))
        out = x.join(r, (F.col("g__") == F.col("m_g__")) & (F.col("x__") == F.col("m_x__")), "left")
        mixed = (1 - self.repair_level) * F.col("x__") + self.repair_level * F.col("y__")
        return out.withColumn(feature, F.coalesce(mixed, "x__")).drop("g__", "x__", "m_g__", "m_x__", "y__")

    def _values_at(self, places: DataFrame, pool: DataFrame, n: int) -> DataFrame:
        """(p__, v): the pool's values at places of its sorted order; places and pool meet in buckets of places, a value in each that it reaches."""
        width = max(1, min(PLACES, -(-n // 256)))
        of = lambda c: F.expr(f"cast(({c}) div {width} as long)")
        have = pool.select("v", "start", F.explode(F.sequence(of("start"), of("start + c - 1"))).alias("b__"))
        want = places.select(F.col("lo__").alias("p__"), of("lo__").alias("b__"))
        both = have.select("b__", F.col("start").alias("at__"), F.lit(0).alias("k__"), "v", F.lit(None).cast("long").alias("p__")).unionByName(want.select("b__", F.col("p__").alias("at__"), F.lit(1).alias("k__"), F.lit(None).cast("double").alias("v"), "p__"))
        w = Window.partitionBy("b__").orderBy("at__", "k__").rowsBetween(Window.unboundedPreceding, 0)
        return stage(both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("k__ = 1").select("p__", "v"))


class DisparateImpactRemover(Estimator):
    """Moves a numeric feature's quantiles in each group to those of all rows; repair_level mixes old and new.

    Groups below min_group_size and NULL groups stay as they are; a group's size counts its missing values too; the feature becomes a double.
    """

    def __init__(self, sensitive: str, features: list[str], repair_level: float = 1.0, min_group_size: int = 20):
        super().__init__()
        if not 0 <= repair_level <= 1:
            raise ValueError("repair_level must be between 0 and 1")
        self.sensitive, self.features, self.repair_level, self.min_group_size = sensitive, features, repair_level, min_group_size

    def _fit(self, df: DataFrame) -> RepairModel:
        require(df, [self.sensitive, *self.features])
        return RepairModel(self.sensitive, {f: _pool(df, f) for f in self.features}, self.repair_level, self.min_group_size)


class DropModel(Model):
    def __init__(self, dropped: list[str], scores: dict[str, float]):
        super().__init__()
        self.dropped, self.scores = dropped, scores

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


def proxy_scores(df: DataFrame, sensitive: list[str], features: list[str], num_cat: str = "cramers_v_str") -> DataFrame:
    """(feature, attribute, score) by the pair's types: numbers |r|, a number and a two-valued text |r| on 0/1 codes, everything else Cramer's V of the texts;
    num_cat='eta' takes the root of eta squared for a number and a text instead. Degenerate pairs score 0."""
    from fairloom.operators.association import anova, moments

    text = {c for c in {*sensitive, *features} if isinstance(df.schema[c].dataType, T.StringType)}
    maybe = sorted(text)
    pairs = [(f, a) for a in sensitive for f in features if f != a]
    near: dict[str, tuple] = {}
    if maybe:  # the texts that may have two values, and these
        r = df.agg(*[x for i, c in enumerate(maybe) for x in (F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"k{i}"), F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"b{i}"))]).first()
        near = {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(maybe) if r[f"k{i}"] <= 3 and r[f"a{i}"] != r[f"b{i}"]}
    code = lambda c: F.when(F.col(f"`{c}`").isNotNull(), (F.col(f"`{c}`") == near[c][1]).cast("double")) if c in text else to_number(without_nan(df, c))
    tried = [(f, a) for f, a in pairs if all(c not in text or c in near for c in (f, a)) and not (f in text and a in text)]
    got, two = None, set()
    if tried:  # the same pass tells which texts have no third value
        others = [F.count(F.when(~F.col(f"`{c}`").isin(*near[c]), 1)).alias(f"o{i}") for i, c in enumerate(near)]
        got = df.agg(*[abs_pearson(code(f), code(a)).alias(f"r{i}") for i, (f, a) in enumerate(tried)], *others).first()
        two = {c for i, c in enumerate(near) if not got[f"o{i}"]}
    linear = {(f, a): got[f"r{i}"] for i, (f, a) in enumerate(tried) if all(c not in text or c in two for c in (f, a))}
    eta = [(f, a) for f, a in pairs if (f, a) not in linear and (f in text) != (a in text)] if num_cat == "eta" else []
    rest = [p for p in pairs if p not in linear and p not in eta]
    spark, parts = df.sparkSession, []
    if linear:
        parts.append(spark.createDataFrame([(f, a, r) for (f, a), r in linear.items()], "feature string, attribute string, score double"))
    if rest:
        parts.append(chi2(contingency_of(df, rest)).select("feature", "attribute", F.coalesce("v", F.lit(0.0)).alias("score")))
    for f, a in eta:
        n, t = (a, f) if f in text else (f, a)
        parts.append(anova(moments(df, [n], [t])).select(F.lit(f).alias("feature"), F.lit(a).alias("attribute"), F.sqrt(F.coalesce("eta2", F.lit(0.0))).alias("score")))
    out = spark.createDataFrame([], "feature string, attribute string, score double")
    for p in parts:
        out = out.unionByName(p)
    return out


class ProxyDropper(Estimator):
    """Drops the features whose strongest association with a sensitive attribute reaches the threshold, the max_drop strongest at most."""

    def __init__(self, sensitive: list[str], features: list[str] | None = None, threshold: float = 0.3, max_drop: int | None = None, num_cat: str = "cramers_v_str"):
        super().__init__()
        self.sensitive, self.features, self.threshold, self.max_drop, self.num_cat = sensitive, features, threshold, max_drop, num_cat

    def _fit(self, df: DataFrame) -> DropModel:
        from fairloom.operators.association import usable

        require(df, [*self.sensitive, *(self.features or [])])
        features = self.features or usable(df, self.sensitive)
        best = {r[0]: r[1] for r in proxy_scores(df, self.sensitive, features, self.num_cat).groupBy("feature").agg(F.max("score")).collect()}  # one row per column
        hit = sorted((f for f in features if best.get(f, 0.0) >= self.threshold), key=lambda f: (-best[f], features.index(f)))
        return DropModel(hit[: self.max_drop] if self.max_drop is not None else hit, best)
