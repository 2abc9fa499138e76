"""Bias detectors of a table before any model: representation, disparities and proxies, and their report."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.functions.special import chi2_p, f_p
from fairloom.operators.association import anova, chi2, moments, split_kinds, usable
from fairloom.operators.grouping import require, without_nan
from fairloom.session import stage


def representation_counts(df: DataFrame, attribute: str, benchmark: dict[str, float] | None = None) -> DataFrame:
    """(attribute, grp, n, proportion, expected): observed groups and those of the benchmark; NULL groups are left out."""
    g = df.select(without_nan(df, attribute).cast("string").alias("grp")).where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"))
    if benchmark:
        b = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in benchmark.items()], "grp string, share double")
        g = g.join(b, "grp", "full_outer").select("grp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        g = g.withColumn("share", F.lit(None).cast("double"))
    total = g.agg(F.sum("n").alias("total")).withColumn("j__", F.lit(1))
    g = g.withColumn("j__", F.lit(1)).join(F.broadcast(total), "j__")  # one row
    return g.select(F.lit(attribute).alias("attribute"), "grp", "n", F.try_divide("n", "total").alias("proportion"), (F.col("share") * F.col("total")).alias("expected"))


def representation_test(counts: DataFrame, method: str = "homogeneity") -> DataFrame:
    """(attribute, chi2, dof): 'homogeneity' takes the expected counts as a second sample (two groups with continuity correction), 'gof' tests the fit."""
    if method not in ("homogeneity", "gof"):
        raise ValueError(f"unknown method {method!r}")
    c = counts.where((F.col("n") > 0) | (F.col("expected") > 0))
    t = c.groupBy("attribute").agg(F.sum("n").alias("so"), F.sum("expected").alias("se"), F.count("*").alias("k"))
    c = c.join(t, "attribute")
    if method == "gof":
        x = F.try_divide((F.col("n") - F.col("expected")) ** 2, F.col("expected"))
    else:
        all_ = F.col("so") + F.col("se")
        eo, ee = (F.col(s) * (F.col("n") + F.col("expected")) / all_ for s in ("so", "se"))
        d = F.abs(F.col("n") - eo)
        d = F.when(F.col("k") == 2, d - F.least(F.lit(0.5), d)).otherwise(d)
        x = d * d * (F.try_divide(F.lit(1.0), eo) + F.try_divide(F.lit(1.0), ee))
    return c.groupBy("attribute").agg(F.sum(x).alias("x"), F.max("k").alias("k")).select("attribute", F.when((F.col("k") >= 2) & F.col("x").isNotNull(), F.col("x")).alias("chi2"), (F.col("k") - 1).alias("dof"))


@dataclass
class RepresentationBiasDetector:
    alpha: float = 0.05
    method: str = "homogeneity"

    def run(self, df: DataFrame, attributes: list[str], benchmarks: dict[str, dict[str, float]] | None = None) -> DataFrame:
        """(attribute, counts, proportions, benchmark, chi2_pvalue, flagged); without a benchmark no p-value and no flag."""
        require(df, attributes)
        out = []
        for a in attributes:
            bench = (benchmarks or {}).get(a)
            c = representation_counts(df, a, bench)
            pair = lambda x: F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", x))))
            r = c.groupBy("attribute").agg(pair("n").alias("counts"), pair("proportion").alias("proportions"))
            if bench:
                b = F.create_map(*[x for k, v in bench.items() for x in (F.lit(str(k)), F.lit(float(v)))])
                r = r.withColumn("benchmark", b).join(representation_test(c, self.method), "attribute").withColumn("chi2_pvalue", chi2_p("chi2", "dof")).drop("chi2", "dof")
            else:
                r = r.withColumn("benchmark", F.lit(None).cast("map<string,double>")).withColumn("chi2_pvalue", F.lit(None).cast("double"))
            out.append(r.withColumn("flagged", F.coalesce(F.col("chi2_pvalue") < self.alpha, F.lit(False))))
        return _union(out)


@dataclass
class StatisticalDisparityDetector:
    alpha: float = 0.05

    def statistics(self, df: DataFrame, attributes: list[str], features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        require(df, [*attributes, *(features or [])])
        features = features or usable(df, attributes)
        counts, cats, nums = split_kinds(df, features, attributes)
        counts = stage(counts)
        x = stage(chi2(counts))
        m = anova(moments(df, nums, attributes)) if nums else None
        if m is not None and cats:  # whole numbers that are categories beside this attribute
            m = m.join(counts.select("feature", "attribute").distinct(), ["feature", "attribute"], "left_anti")
        return x, m

    def run(self, df: DataFrame, attributes: list[str], features: list[str] | None = None) -> DataFrame:
        """(feature, attribute, test, pvalue, flagged) for each pair."""
        x, m = self.statistics(df, attributes, features)
        out = x.select("feature", "attribute", F.lit("chi2").alias("test"), chi2_p("chi2", F.col("dof").cast("double")).alias("pvalue"))
        if m is not None:
            out = out.unionByName(m.select("feature", "attribute", F.lit("anova").alias("test"), f_p("f", F.col("dfb").cast("double"), F.col("dfw").cast("double")).alias("pvalue")))
        return out.withColumn("flagged", F.coalesce(F.col("pvalue") < self.alpha, F.lit(False)))


@dataclass
class ProxyVariableDetector:
    threshold: float = 0.30

    def run(self, df: DataFrame, attributes: list[str], features: list[str] | None = None) -> DataFrame:
        """(feature, attribute, measure, strength, flagged): Cramer's V of categories, eta squared of numbers."""
        x, m = StatisticalDisparityDetector().statistics(df, attributes, features)
        out = x.select("feature", "attribute", F.lit("cramers_v").alias("measure"), F.col("v").alias("strength"))
        if m is not None:
            out = out.unionByName(m.select("feature", "attribute", F.lit("eta_squared").alias("measure"), F.col("eta2").alias("strength")))
        return out.withColumn("flagged", F.coalesce(F.col("strength") >= self.threshold, F.lit(False)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class BiasReport:
    """The results of all detectors; a mapping of meta and body once collected."""

    representation: DataFrame
    disparities: DataFrame
    proxies: DataFrame
    sensitive: list[str]
    alpha: float
    proxy_threshold: float

    def to_dict(self) -> dict:
        rows = lambda d: [r.asDict(recursive=True) for r in d.collect()]  # noqa: E731  one row per attribute or pair
        body = {"representation": rows(self.representation), "disparities": rows(self.disparities), "proxies": rows(self.proxies)}
        flags = {f"{name}_flags": sum(r["flagged"] for r in body[k]) for name, k in (("representation", "representation"), ("disparity", "disparities"), ("proxy", "proxies"))}
        summary = {"sensitive": self.sensitive, "alpha": self.alpha, "proxy_threshold": self.proxy_threshold, **flags}
        return {"meta": {"phase": "0", "alpha": self.alpha, "proxy_threshold": self.proxy_threshold}, "body": {"summary": summary, **body}}

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), ensure_ascii=False, indent=2)
        if path:
            from fairloom.sources.files import write_text

            write_text(path, text)
        return text


def run_detectors(df: DataFrame, sensitive: list[str], benchmarks: dict | None = None, alpha: float = 0.05, proxy_threshold: float = 0.30, features: list[str] | None = None) -> BiasReport:
    rep = RepresentationBiasDetector(alpha).run(df, sensitive, benchmarks)
    dis = StatisticalDisparityDetector(alpha).run(df, sensitive, features)
    return BiasReport(rep, dis, ProxyVariableDetector(proxy_threshold).run(df, sensitive, features), list(sensitive), alpha, proxy_threshold)
