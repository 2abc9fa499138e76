"""Queries of the fairness operators over the test tables, each with an SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.functions.bootstrap import gap_per_draw, hashed_sums, metric_interval
from fairloom.functions.scalar import benjamini_hochberg, bonferroni, cohens_d, risk_ratio, to_number
from fairloom.functions.special import chi2_p, credible, f_p
from fairloom.operators import association, metrics
from fairloom.operators.detectors import ProxyVariableDetector, RepresentationBiasDetector, StatisticalDisparityDetector, representation_counts, representation_test, run_detectors
from fairloom.operators.grouping import group_sizes, label, min_group_mask
from fairloom.operators.mitigation import DisparateImpactRemover, InstanceReweighting, ProxyDropper, ReweighingTransformer, proxy_scores
from fairloom.training import losses
from fairloom.training.calibration import GroupFairnessCalibrator
from fairloom.training.trainers import LagrangianFairnessTrainer, ReductionsWrapper, sweep_pareto

QUERIES, SQL = [], {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES.append(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as predictions: of the line status by the discount, of the price by the quantity."""
    li = _table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.05).cast("int").alias("y_pred"), (F.col("l_linestatus") == "F").cast("int").alias("y_true"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 1500.0).alias("guess"))


_L = """l as (select l_returnflag, l_linestatus, case when l_discount >= 0.05 then 1 else 0 end as y_pred, case when l_linestatus = 'F' then 1 else 0 end as y_true,
  l_extendedprice as price, l_quantity * 1500.0 as guess from lineitem)"""
_G = """g as (select {g} as grp, count(*) as n, avg({p}) as rate, avg(case when {t} = 1 then {p} end) as tpr, avg(case when {t} = 0 then {p} end) as fpr,
  avg(abs({t} - {p})) as mae, var_samp(abs({t} - {p})) as v from {src} where {g} is not null and {p} is not null and {t} is not null group by 1 having count(*) >= {k})"""
_GAP = "case when count({c}) >= 2 then max({c}) - min({c}) end"
_RATIO = "case when count(case when {c} > 0 then 1 end) >= 2 then max({c}) / min(case when {c} > 0 then {c} end) end"


def _gap(c: str) -> str:
    return _GAP.format(c=c)


_EOD = f"greatest({_gap('tpr')}, {_gap('fpr')})"
_EOD_EFFECT = f"greatest({_RATIO.format(c='tpr')}, {_RATIO.format(c='fpr')})"
_DPD_EFFECT = "case when count(rate) >= 2 and min(rate) <> 0 then max(rate) / min(rate) end"

@query(f"""with {_L}, {_G.format(g="l_returnflag", p="y_pred", t="y_true", src="l", k=30)},
h as ({_G.format(g="l_returnflag", p="guess", t="price", src="l", k=30)[6:-1]})
select 'demographic_parity_difference' as metric, round({_gap("rate")}, 8) as value, round({_DPD_EFFECT}, 8) as effect_size, count(*) as n_groups from g
union all select 'equalized_odds_difference', round({_EOD}, 8), round({_EOD_EFFECT}, 8), count(*) from g
union all select 'mae_parity_difference', round({_gap("mae")}, 8), round((select (a.mae - b.mae) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))
  from (select * from h order by mae desc, grp limit 1) a, (select * from h order by mae, grp limit 1) b), 8), count(*) from h""")
def metrics_returnflag(spark: SparkSession, d: str) -> DataFrame:
    """M1 to M3 with effect sizes E3, E5, E6 by return flag."""
    li = _lines(spark, d)
    s, m = metrics.group_stats_of(li, "l_returnflag", {"class": ("y_pred", "y_true"), "value": ("guess", "price")}).values()
    named = lambda n, x: x.select(F.lit(n).alias("metric"), "value", "effect_size", "n_groups")
    out = named("demographic_parity_difference", metrics.dpd(s)).unionByName(named("equalized_odds_difference", metrics.eod(s)))
    return _r(out.unionByName(named("mae_parity_difference", metrics.mae_parity(m))))


@query(f"""with {_L}, {_G.format(g="l_returnflag", p="y_pred", t="y_true", src="l", k=30)}
select grp, n, round(rate, 8) as rate, round(tpr, 8) as tpr, round(fpr, 8) as fpr, round(mae, 8) as mae from g""")
def group_rates_returnflag(spark: SparkSession, d: str) -> DataFrame:
    """M6."""
    return _r(metrics.group_stats(_lines(spark, d), "l_returnflag", "y_pred", "y_true").select("grp", "n", "rate", "tpr", "fpr", "mae"))


@query(f"""with {_G.format(g="sensitive", p="y_pred", t="y_true", src="dev_sample", k=30)}
select round({_gap("rate")}, 8) as dpd, round({_EOD}, 8) as eod, round({_gap("mae")}, 8) as mae, count(*) as n_groups from g""")
def metrics_dirty(spark: SparkSession, d: str) -> DataFrame:
    """M1 to M3 over scored records with missing groups, predictions and labels; small groups drop out (P3 to P5)."""
    (s,) = metrics.group_stats_of(_table(spark, d, "dev_sample"), "sensitive", {"y": ("y_pred", "y_true")}).values()
    j = lambda x, n: x.select(F.col("value").alias(n), F.col("n_groups"))
    return _r(j(metrics.dpd(s), "dpd").join(j(metrics.eod(s), "eod"), "n_groups").join(j(metrics.mae_parity(s), "mae"), "n_groups"))


@query("""with g as (select sensitive as grp, avg(case when y_true = 1 then score end) as tpr, avg(case when y_true = 0 then score end) as fpr
  from (select * from dev_sample where not isnan(score) and not isinf(score)) where sensitive is not null and score is not null and y_true is not null group by 1 having count(*) >= 30)
select round(case when count(tpr) >= 2 and count(fpr) >= 2 then greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) end, 8) as value from g""")
def eod_strict(spark: SparkSession, d: str) -> DataFrame:
    """M2b, on scores."""
    df = _table(spark, d, "dev_sample")
    return _r(metrics.eod(metrics.group_stats(df, "sensitive", "score", "y_true"), "strict").select("value"))


@query("""with g as (select p_brand as grp, count(*) as n, avg(case when p_size > 25 then 1 else 0 end) as rate from part group by 1 having count(*) >= 80)
select round(case when count(*) >= 2 then max(rate) - min(rate) end, 8) as value, count(*) as n_groups from g""")
def dpd_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """P5: brands below 80 parts are left out."""
    p = _table(spark, d, "part").select("p_brand", (F.col("p_size") > 25).cast("int").alias("y_pred"))
    return _r(metrics.dpd(metrics.group_stats(p, "p_brand", "y_pred", min_group_size=80)).select("value", "n_groups"))


@query("""with g as (select o_orderpriority || '||' || o_orderstatus as grp, count(*) as n, avg(case when o_totalprice > 250000 then 1 else 0 end) as rate from orders group by 1 having count(*) >= 30)
select grp, n, round(rate, 8) as rate, round((select max(rate) - min(rate) from g), 8) as value from g""")
def dpd_intersectional(spark: SparkSession, d: str) -> DataFrame:
    """M4 over two attributes."""
    o = _table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 250000).cast("int").alias("y_pred"))
    s = metrics.group_stats(o, ["o_orderpriority", "o_orderstatus"], "y_pred")
    return _r(s.select("grp", "n", "rate", F.lit(1).alias("j")).join(metrics.dpd(s).select("value", F.lit(1).alias("j")), "j").drop("j"))


@query("""with r as (select o_orderpriority, o_orderstatus, case when o_totalprice > 250000 then 1 else 0 end as p from orders),
g as (select case when grouping(o_orderpriority) = 0 and grouping(o_orderstatus) = 0 then 'o_orderpriority||o_orderstatus' when grouping(o_orderpriority) = 0 then 'o_orderpriority' else 'o_orderstatus' end as attributes,
  avg(p) as rate from r group by grouping sets ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus)) having count(*) >= 30)
select attributes, round(case when count(*) >= 2 then max(rate) - min(rate) end, 8) as value, count(*) as n_groups from g group by 1""")
def dpd_all_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Every subset of the attributes in one pass."""
    o = _table(spark, d, "orders").withColumn("y_pred", (F.col("o_totalprice") > 250000).cast("int"))
    return _r(metrics.rates_by_subset(o, ["o_orderpriority", "o_orderstatus"], "y_pred"))


@query("""select coalesce(sensitive, 'NaN') || '||' || coalesce(cast(y_true as varchar), 'NaN') as grp, count(*) as n from dev_sample group by 1""")
def labels_include(spark: SparkSession, d: str) -> DataFrame:
    """P8 with missing values written out, P7."""
    df = _table(spark, d, "dev_sample")
    return group_sizes(df, label(df, ["sensitive", "y_true"], "include")).withColumnRenamed("group", "grp")


@query("""select sensitive || '||' || cast(y_true as varchar) as grp, count(*) as n from dev_sample where sensitive is not null and y_true is not null group by 1""")
def labels_exclude(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "dev_sample")
    return group_sizes(df, label(df, ["sensitive", "y_true"])).withColumnRenamed("group", "grp")


@query("""select kept, count(*) as n from (select count(*) over (partition by sensitive) >= 1000 as kept from dev_sample) group by 1""")
def min_group_rows(spark: SparkSession, d: str) -> DataFrame:
    """P6: rows of groups with at least 1000."""
    return min_group_mask(_table(spark, d, "dev_sample"), F.col("sensitive"), 1000).groupBy("kept").agg(F.count("*").alias("n"))


@query("""with c as (select o_orderpriority as f, o_orderstatus as a, count(*) as n from orders group by 1, 2),
e as (select n, sum(n) over (partition by f) as r, sum(n) over (partition by a) as k, sum(n) over () as t from c),
x as (select sum(n * n / (r * k)) - 1 as phi, max(t) as t from e),
y as (select t * phi as chi2, sqrt(phi / 2) as v, t from x)
select round(chi2, 6) as chi2, 8 as dof, round(v, 8) as v, round(exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2 + (chi2 / 2) ** 3 / 6), 8) as pvalue from y""")
def chi2_priority_status(spark: SparkSession, d: str) -> DataFrame:
    """D2, D4, D8; eight degrees of freedom have a closed p-value."""
    x = association.chi2(association.contingency(_table(spark, d, "orders"), ["o_orderpriority"], ["o_orderstatus"]))
    return x.select(F.round("chi2", 6).alias("chi2"), F.col("dof").cast("int").alias("dof"), F.round("v", 8).alias("v"), F.round(chi2_p("chi2", F.col("dof").cast("double")), 8).alias("pvalue"))


@query("""with g as (select o_orderstatus as a, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1),
t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as mm from g),
s as (select sum(g.n * (m - mm) ** 2) as b, sum((g.n - 1) * v) as w, max(t.n) as n, max(k) as k from g, t),
f as (select (b / (k - 1)) / (w / (n - k)) as f, n - k as d2, b / (b + w) as eta2 from s)
select round(f, 6) as f, cast(d2 as bigint) as dfw, round(eta2, 10) as eta2, round((d2 / (d2 + 2 * f)) ** (d2 / 2), 8) as pvalue from f""")
def anova_value_status(spark: SparkSession, d: str) -> DataFrame:
    """D2, D5; three groups have a closed p-value."""
    a = association.anova(association.moments(_table(spark, d, "orders"), ["o_totalprice"], ["o_orderstatus"]))
    return a.select(F.round("f", 6).alias("f"), "dfw", F.round("eta2", 10).alias("eta2"), F.round(f_p("f", F.col("dfb").cast("double"), F.col("dfw").cast("double")), 8).alias("pvalue"))


@query("""select round(abs(corr(l_quantity, l_extendedprice)), 8) as quantity_price, round(abs(corr(case when l_linestatus = 'O' then 1.0 else 0.0 end, l_discount)), 8) as status_discount from lineitem""")
def pearson_proxy(spark: SparkSession, d: str) -> DataFrame:
    """D7, P20."""
    li = _table(spark, d, "lineitem")
    return _r(li.agg(association.abs_pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("quantity_price"), association.abs_pearson((F.col("l_linestatus") == "O").cast("double"), F.col("l_discount")).alias("status_discount")))


_BENCH = {"MACHINERY": 0.3, "FURNITURE": 0.2, "BUILDING": 0.2, "AUTOMOBILE": 0.2, "GARDEN": 0.1}
_BENCH_SQL = ", ".join(f"('{k}', {v})" for k, v in _BENCH.items())


@query(f"""with b(grp, share) as (values {_BENCH_SQL}), o as (select c_mktsegment as grp, count(*) as n from customer group by 1),
c as (select coalesce(o.grp, b.grp) as grp, coalesce(n, 0) as n, coalesce(share, 0) * (select sum(n) from o) as e from o full join b on o.grp = b.grp),
k as (select * from c where n > 0 or e > 0), t as (select sum(n) as so, sum(e) as se, count(*) as k from k)
select round(sum((n - so * (n + e) / (so + se)) ** 2 * (1 / (so * (n + e) / (so + se)) + 1 / (se * (n + e) / (so + se)))), 6) as homogeneity, max(k) - 1 as dof from k, t""")
def representation_segment(spark: SparkSession, d: str) -> DataFrame:
    """D1 against a skewed benchmark with a group nobody has, J2."""
    t = representation_test(representation_counts(_table(spark, d, "customer"), "c_mktsegment", _BENCH))
    return t.select(F.round("chi2", 6).alias("homogeneity"), "dof")


@query("""with o as (select o_orderstatus as grp, count(*) as n from orders group by 1), t as (select sum(n) as t from o), b(grp, share) as (values ('F', 0.3), ('O', 0.3), ('P', 0.4))
select grp, n, round(n / t, 8) as proportion, cast(round(share * t, 6) as double) as expected, cast(round((select sum((n - share * t) ** 2 / (share * t)) from o join b using (grp), t), 6) as double) as gof from o join b using (grp), t""")
def representation_gof(spark: SparkSession, d: str) -> DataFrame:
    """D1 as a test of fit."""
    c = representation_counts(_table(spark, d, "orders"), "o_orderstatus", {"F": 0.3, "O": 0.3, "P": 0.4})
    t = representation_test(c, "gof").select("attribute", F.round("chi2", 6).alias("gof"))
    return c.join(t, "attribute").select("grp", "n", F.round("proportion", 8).alias("proportion"), F.round("expected", 6).alias("expected"), "gof")


_STATUS = {"F": 0.3, "O": 0.3, "P": 0.4}
_DETECT = """c as (select o_orderpriority as f, o_orderstatus as a, count(*) as n from orders group by 1, 2),
e as (select n, sum(n) over (partition by f) as r, sum(n) over (partition by a) as k, sum(n) over () as t from c),
x as (select max(t) * (sum(n * n / (r * k)) - 1) as x, sqrt((sum(n * n / (r * k)) - 1) / 2) as v from e),
g as (select o_orderstatus as a, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1),
t as (select sum(n) as n, sum(n * m) / sum(n) as mm from g),
s as (select sum(g.n * (m - mm) ** 2) as b, sum((g.n - 1) * v) as w, max(t.n) - 3 as d2 from g, t),
d as (select 'o_orderpriority' as feature, 'chi2' as test, exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) as p, 'cramers_v' as measure, v as strength from x
  union all select 'o_totalprice', 'anova', (d2 / (d2 + 2 * (b / 2) / (w / d2))) ** (d2 / 2), 'eta_squared', b / (b + w) from s),
o as (select o_orderstatus as grp, count(*) as n from orders group by 1), b(grp, share) as (values ('F', 0.3), ('O', 0.3), ('P', 0.4)),
h as (select sum((n - e) ** 2 / (2 * (n + e)) * 2) as x from (select n, share * (select sum(n) from o) as e from o join b using (grp)))"""


@query(f"""with {_DETECT} select feature, 'o_orderstatus' as attribute, test, round(p, 8) as pvalue, p < 0.05 as flagged from d""")
def detector_disparity(spark: SparkSession, d: str) -> DataFrame:
    """D2: routing, p-values and flags; eight degrees of freedom and three groups have closed p-values."""
    return _r(StatisticalDisparityDetector().run(_table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority", "o_totalprice"]))


@query(f"""with {_DETECT} select feature, 'o_orderstatus' as attribute, measure, round(strength, 8) as strength, strength >= 0.3 as flagged from d""")
def detector_proxy(spark: SparkSession, d: str) -> DataFrame:
    """D3, P11."""
    return _r(ProxyVariableDetector().run(_table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority", "o_totalprice"]))


@query(f"""with {_DETECT} select 'o_orderstatus' as attribute, round(exp(-x / 2), 8) as chi2_pvalue, exp(-x / 2) < 0.05 as flagged from h""")
def detector_representation(spark: SparkSession, d: str) -> DataFrame:
    """D1 with p-value and flag; two degrees of freedom."""
    return _r(RepresentationBiasDetector().run(_table(spark, d, "orders"), ["o_orderstatus"], {"o_orderstatus": _STATUS}).select("attribute", "chi2_pvalue", "flagged"))


@query(f"""with {_DETECT} select (select cast(exp(-x / 2) < 0.05 as int) from h) as representation_flags, cast(sum(cast(p < 0.05 as int)) as int) as disparity_flags,
  cast(sum(cast(strength >= 0.3 as int)) as int) as proxy_flags from d""")
def detector_report(spark: SparkSession, d: str) -> DataFrame:
    """D9: the report's summary."""
    r = run_detectors(_table(spark, d, "orders"), ["o_orderstatus"], {"o_orderstatus": _STATUS}, features=["o_orderpriority", "o_totalprice"]).to_dict()
    s = r["body"]["summary"]
    return spark.createDataFrame([(s["representation_flags"], s["disparity_flags"], s["proxy_flags"])], "representation_flags int, disparity_flags int, proxy_flags int")


_P_TABLE = """p as (select l_returnflag as k, (d2 / (d2 + 2 * f)) ** (d2 / 2) as p from (select l_returnflag, n - 3 as d2, (b / 2) / (w / (n - 3)) as f from (
  select l_returnflag, sum(n) as n, sum(n * (m - mm) ** 2) as b, sum((n - 1) * v) as w from (
    select l_returnflag, l_linenumber % 3 as a, count(*) as n, avg(l_tax) as m, var_samp(l_tax) as v, sum(sum(l_tax)) over (partition by l_returnflag) / sum(count(*)) over (partition by l_returnflag) as mm
    from lineitem group by 1, 2) group by 1)))"""


@query(f"""with {_P_TABLE}, r as (select k, p, row_number() over (order by p, k) as i, count(*) over () as m from p)
select k, round(p, 8) as p, round(least(1, p * m), 8) as p_bonferroni, round(least(1, min(p * m / i) over (order by i desc rows between unbounded preceding and current row)), 8) as p_bh from r""")
def multiple_tests(spark: SparkSession, d: str) -> DataFrame:
    """T-1, T-2 over the p-values of one test per return flag; W2, W3."""
    li = _table(spark, d, "lineitem").withColumn("part", (F.col("l_linenumber") % 3).cast("string"))
    wide = li.select(*[F.when(F.col("l_returnflag") == f, F.col("l_tax")).alias(f) for f in "ANR"], "part")
    a = association.anova(association.moments(wide, list("ANR"), ["part"]))
    p = a.select(F.col("feature").alias("k"), f_p("f", F.col("dfb").cast("double"), F.col("dfw").cast("double")).alias("p"))
    return _r(benjamini_hochberg(bonferroni(p, "p"), "p", ["k"]))


@query("""with g as (select l_returnflag as k, count(*) as n, avg(l_discount) as m, var_samp(l_discount) as v from lineitem group by 1), a as (select * from g where k = 'A'), r as (select * from g where k = 'R')
select round(a.m / r.m, 8) as ratio, round((a.m - r.m) / sqrt(((a.n - 1) * a.v + (r.n - 1) * r.v) / (a.n + r.n - 2)), 8) as d from a, r""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    """E1, E2."""
    li = _table(spark, d, "lineitem")
    of = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_discount"))
    s = li.agg(*[x for f in "AR" for x in (F.count(of(f)).alias(f"n{f}"), F.avg(of(f)).alias(f"m{f}"), F.var_samp(of(f)).alias(f"v{f}"))])
    c = {k: F.col(k) for k in ("nA", "mA", "vA", "nR", "mR", "vR")}
    return _r(s.select(risk_ratio(c["mA"], c["mR"]).alias("ratio"), cohens_d(c["nA"], c["mA"], c["vA"], c["nR"], c["mR"], c["vR"]).alias("d")))


@query()
def credible_intervals(spark: SparkSession, d: str) -> DataFrame:
    """B8: of each return flag's rate."""
    s = metrics.group_stats(_lines(spark, d), "l_returnflag", "y_pred")
    return s.select("grp", "n", "rate", credible(F.col("rate") * F.col("n"), F.col("n")).alias("c")).select("grp", "n", "rate", "c.lo", "c.hi")


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """B1 to B5, B7: percentile and BCa, by group and over all rows."""
    li, out = _lines(spark, d), []
    for name, yt in (("demographic_parity_difference", None), ("equalized_odds_difference", "y_true")):
        for method in ("percentile", "bca"):
            for strat in (True, False):
                out.append((name, method, strat, *metric_interval(name, li, "l_returnflag", "y_pred", yt, 30, "exclude", 0.95, method, 2000, 42, strat)))
    return spark.createDataFrame(out, "metric string, method string, stratified boolean, lo double, hi double")


@query()
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    """B7 (2): errors are no counts."""
    lo, hi = metric_interval("mae_parity_difference", _lines(spark, d), "l_returnflag", "guess", "price", 30, "exclude", 0.95, "percentile", 2000, 42, key=["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


_DRAWS = """b as (select unnest(range(20)) as b), r as (select b, o_orderstatus as g, case when o_totalprice > 250000 then 1 else 0 end as p,
  ('0x' || substr(md5(cast(o_orderkey as varchar) || ':' || cast(b as varchar)), 1, 8))::bigint / 4294967296.0 as u from orders, b),
w as (select b, g, p, case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3
  when u < 0.9963401531726563 then 4 when u < 0.9994058151824183 then 5 when u < 0.9999167588507119 then 6 else 7 end as w from r)"""


@query(f"""with {_DRAWS}, s as (select b, g, sum(w * p) / sum(w) as rate from w group by 1, 2) select b, round(max(rate) - min(rate), 8) as value from s group by 1""")
def md5_bootstrap_dpd(spark: SparkSession, d: str) -> DataFrame:
    """B7 (3): Poisson weights from a hash of the row's key, the same wherever it runs."""
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 250000).cast("int").alias("p"))
    return _r(gap_per_draw(hashed_sums(o, "o_orderstatus", "p", "o_orderkey", 20)).select(F.col("b").cast("long").alias("b"), "value"))


@query("""with o as (select c_mktsegment as g, count(*) as n from customer group by 1), t as (select sum(n) as t, count(*) as k from o),
w as (select g, n, least(greatest(greatest(1, round_even(t / k, 0)) / n, 0.1), 10) as w from o, t), m as (select sum(n * w) / sum(n) as m from w)
select g as c_mktsegment, n, round(w / m, 8) as sample_weight from w, m""")
def reweight_inverse(spark: SparkSession, d: str) -> DataFrame:
    """T1 without a benchmark, W4."""
    c = _table(spark, d, "customer")
    w = InstanceReweighting(["c_mktsegment"]).fit(c).transform(c)
    return _r(w.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("sample_weight").alias("sample_weight")))


@query(f"""with b(g, share) as (values {_BENCH_SQL}), o as (select c_mktsegment as g, count(*) as n from customer group by 1), t as (select sum(n) as t from o),
w as (select o.g, n, least(greatest(greatest(1, round_even(coalesce(share, 0) * t, 0)) / n, 0.1), 10) as w from o left join b using (g), t), m as (select sum(n * w) / sum(n) as m from w)
select g as c_mktsegment, n, round(w / m, 8) as sample_weight from w, m""")
def reweight_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """T1, P16, P17, J1."""
    c = _table(spark, d, "customer")
    w = InstanceReweighting(["c_mktsegment"], {"c_mktsegment": _BENCH}).fit(c).transform(c)
    return _r(w.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("sample_weight").alias("sample_weight")))


@query("""with s as (select sensitive as g, count(*) as n from dev_sample group by 1), y as (select y_true as y, count(*) as n from dev_sample group by 1), t as (select count(*) as t from dev_sample),
c as (select sensitive, y_true, count(*) as n from dev_sample group by 1, 2),
w as (select c.*, least(greatest(1e-9, (1.0 / (select count(*) from s)) / (s.n / t)) * greatest(1e-9, (1.0 / (select count(*) from y)) / (y.n / t)), 8) as w
  from c join s on c.sensitive is not distinct from s.g join y on c.y_true is not distinct from y.y, t), m as (select sum(n * w) / sum(n) as m from w)
select sensitive, y_true, n, round(w / m, 8) as sample_weight from w, m""")
def reweigh_clip(spark: SparkSession, d: str) -> DataFrame:
    """T2 over two attributes with NULL groups."""
    c = _table(spark, d, "dev_sample")
    w = ReweighingTransformer(["sensitive", "y_true"], clip=8).fit(c).transform(c)
    return _r(w.groupBy("sensitive", "y_true").agg(F.count("*").alias("n"), F.min("sample_weight").alias("sample_weight")))


_REPAIR = """with x as (select {id} as id, {g} as g, {x} as x from {t}), n as (select count(x) as n from x), s as (select g, count(*) as ng from x where g is not null group by 1),
pool as (select x as v, row_number() over (order by x) - 1 as pos from x where x is not null),
r as (select id, g, x, ng, n, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2 as rho from x join s using (g), n where x is not null and ng >= 20),
i as (select *, least(greatest((rho - 0.5) * n / ng - 0.5, 0), n - 1) as i from r),
m as (select id, a.v + (i - floor(i)) * (b.v - a.v) as y from i join pool a on a.pos = floor(i) join pool b on b.pos = least(floor(i) + 1, n - 1))
select x.id as {id}, round(coalesce({k} * x.x + {r} * m.y, x.x), 6) as {x} from x left join m using (id)"""


@query(_REPAIR.format(id="p_partkey", g="p_type", x="p_retailprice", t="part", k=0.2, r=0.8))
def di_repair(spark: SparkSession, d: str) -> DataFrame:
    """T3, W1, W5, J3."""
    p = _table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return _r(DisparateImpactRemover("p_type", ["p_retailprice"], 0.8).fit(p).transform(p).select("p_partkey", "p_retailprice"), 6)


@query(_REPAIR.format(id="event_id", g="event_type", x="value", t="events", k=0.0, r=1.0))
def di_repair_full(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", "event_type", "value")
    return _r(DisparateImpactRemover("event_type", ["value"]).fit(e).transform(e).select("event_id", "value"), 6)


_V = """(with c as (select {f} as f, {a} as a, count(*) as n from lineitem group by 1, 2), e as (select n, sum(n) over (partition by f) as r, sum(n) over (partition by a) as k from c)
  select round(sqrt(greatest(sum(n * n / (r * k)) - 1, 0) / (least((select count(distinct f) from c), (select count(distinct a) from c)) - 1)), 6) from e)"""


@query(f"""select 'l_discount' as feature, 'l_linestatus' as attribute, round(abs(corr(l_discount, case when l_linestatus = 'O' then 1.0 else 0.0 end)), 6) as score from lineitem
union all select 'l_returnflag', 'l_linestatus', {_V.format(f="l_returnflag", a="l_linestatus")}
union all select 'l_linenumber', 'l_linestatus', round(abs(corr(l_linenumber, case when l_linestatus = 'O' then 1.0 else 0.0 end)), 6) from lineitem
union all select 'l_returnflag', 'l_tax', {_V.format(f="l_returnflag", a="l_tax")}
union all select 'l_discount', 'l_tax', round(abs(corr(l_discount, l_tax)), 6) from lineitem
union all select 'l_linenumber', 'l_tax', round(abs(corr(l_linenumber, l_tax)), 6) from lineitem""")
def proxy_scores_lines(spark: SparkSession, d: str) -> DataFrame:
    """T4's scores by the types of the pair; D6, P18 to P20."""
    return _r(proxy_scores(_table(spark, d, "lineitem"), ["l_linestatus", "l_tax"], ["l_discount", "l_returnflag", "l_linenumber"]), 6)


@query("""select l_linestatus, count(*) as n, 'copy' as dropped from lineitem group by 1""")
def proxy_drop(spark: SparkSession, d: str) -> DataFrame:
    """T4: what is left of a table whose status gives away its copy; W6."""
    li = _table(spark, d, "lineitem").select("l_linestatus", "l_discount", F.concat_ws("-", F.lit("s"), "l_linestatus").alias("copy"))
    m = ProxyDropper(["l_linestatus"]).fit(li)
    return m.transform(li).groupBy("l_linestatus").agg(F.count("*").alias("n")).withColumn("dropped", F.lit(",".join(m.dropped)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    return li.select(((F.col("l_quantity") - 25) / 10 - F.col("l_discount") * 8).alias("logit"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linestatus") == "O").cast("int").alias("s"))


_SCORED = """x as (select (l_quantity - 25) / 10 - l_discount * 8 as z, case when l_returnflag = 'R' then 1 else 0 end as y, case when l_linestatus = 'O' then 1 else 0 end as s from lineitem),
p as (select *, 1 / (1 + exp(-z)) as p, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) as l from x)"""


@query(f"""with {_SCORED} select round(avg(l), 8) as bce, round(abs(covar_pop(p, s)), 10) as penalty, round(avg(l) + 0.5 * abs(covar_pop(p, s)), 8) as loss from p""")
def loss_covariance(spark: SparkSession, d: str) -> DataFrame:
    """R3, P13."""
    a = losses.regularized_loss(_scored(spark, d), "logit", "y", "s")
    return a.select(F.round("bce", 8).alias("bce"), F.round("penalty", 10).alias("penalty"), F.round("loss", 8).alias("loss"))


@query(f"""with {_SCORED}, g as (select avg(case when y = 1 then 2 * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) else ln(1 + exp(-abs(z))) + greatest(z, 0) end) as b,
  (avg(case when s = 0 then p end) - avg(case when s = 1 then p end)) ** 2 as q from p) select round(b, 8) as bce, round(q, 10) as penalty, round(b + 0.2 * q, 8) as loss from g""")
def loss_mean_gap(spark: SparkSession, d: str) -> DataFrame:
    a = losses.regularized_loss(_scored(spark, d), "logit", "y", "s", 0.2, "mean_gap", 2.0)
    return a.select(F.round("bce", 8).alias("bce"), F.round("penalty", 10).alias("penalty"), F.round("loss", 8).alias("loss"))


@query(f"""with {_SCORED} select round(abs(avg(case when s = 1 then p end) - avg(case when s = 0 then p end)) - 0.01, 8) as violation from p""")
def dp_violation(spark: SparkSession, d: str) -> DataFrame:
    """R4."""
    return _r(losses.demographic_parity_violation(_scored(spark, d), "logit", "s", 0.01))


@query(f"""with {_SCORED} select round(abs(avg(case when s = 1 and y = 1 then case when p >= 0.5 then 1 else 0 end end) - avg(case when s = 0 and y = 1 then case when p >= 0.5 then 1 else 0 end end)) - 0.01, 8) as violation from p""")
def eo_violation(spark: SparkSession, d: str) -> DataFrame:
    """R5, P12."""
    return _r(losses.equal_opportunity_violation(_scored(spark, d), "logit", "y", "s", 0.01))


def _training(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "dev_sample")
    return c.select((F.col("score") * 2 - 1).alias("f0"), F.col("y_pred").cast("double").alias("f1"), F.col("y_true").alias("y"), (F.col("sensitive") == "A").cast("int").alias("s"))


@query()
def train_lagrangian(spark: SparkSession, d: str) -> DataFrame:
    """R6."""
    t = LagrangianFairnessTrainer().fit(_training(spark, d), ["f0", "f1"])
    return spark.createDataFrame([(h["epoch"], float(h["accuracy"]), float(h["violation"]), float(h["lambda"])) for h in t.history], "epoch int, accuracy double, violation double, lambda double")


@query()
def train_pareto(spark: SparkSession, d: str) -> DataFrame:
    """R7, R8, W8."""
    pts = sweep_pareto(_training(spark, d), ["f0", "f1"], order="f0")
    return spark.createDataFrame([(float(p["eta"]), float(p["accuracy"]), float(p["dp_diff"])) for p in pts], "eta double, accuracy double, dp_diff double")


@query()
def train_reductions(spark: SparkSession, d: str) -> DataFrame:
    """R1, R2: the groups' rates under the mixture."""
    t = _training(spark, d)
    m = ReductionsWrapper().fit(t, ["f0", "f1"])
    return m.predict(t).groupBy("s").agg(F.count("*").alias("n"), F.avg("prediction_fair").alias("rate"))


def _calibrated(spark: SparkSession, d: str, method: str) -> DataFrame:
    """A fit with an intercept, and an isotonic one, keep the mean label of the rows they were learnt from."""
    c = _table(spark, d, "dev_sample").select("rec_id", "score", F.col("y_true").alias("y"), F.col("sensitive").alias("g"))
    out = GroupFairnessCalibrator(method).fit(c).transform(c)
    used = (F.abs("score") < float("inf")) & F.col("y").isin(0, 1)
    return _r(out.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.when(used, F.col("score_cal"))).alias("mean_cal"), F.avg(F.when(used, F.col("y"))).alias("mean_y")), 6)


_CALIBRATED = """with u as (select sensitive as g, case when y_true in (0, 1) and score is not null and not isnan(score) and not isinf(score) then y_true end as y, score as x from dev_sample)
select g, count(*) as n, round(case when g is not null and count(y) >= 20{both} then avg(y) else avg(case when y is not null then x end) end, 6) as mean_cal, round(avg(y), 6) as mean_y from u group by 1"""


@query(_CALIBRATED.format(both=" and avg(y) > 0 and avg(y) < 1"))
def calibrate_platt(spark: SparkSession, d: str) -> DataFrame:
    """R9, R10."""
    return _calibrated(spark, d, "platt")


@query(_CALIBRATED.format(both=""))
def calibrate_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, "isotonic")


@query("""select cast(count(try_cast(props as double)) as bigint) as numbers, count(distinct event_type) as kinds from events""")
def coerced_numbers(spark: SparkSession, d: str) -> DataFrame:
    """P18, P19."""
    return _table(spark, d, "events").agg(F.count(to_number(F.col("props"))).alias("numbers"), F.count_distinct("event_type").alias("kinds"))


_WINDOWS = """with r as (select date_trunc('hour', ts) as window_start, event_type as grp, case when value > 10 then 1 else 0 end as p from events),
g as (select window_start, grp, avg(p) as rate from r group by 1, 2 having count(*) >= 5)
select window_start, round(case when count(*) >= 2 then max(rate) - min(rate) end, 8) as dpd, count(*) as n_groups from g {closed} group by 1"""


def _windows(g: DataFrame) -> DataFrame:
    return _r(g.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "dpd", "n_groups"))


@query(_WINDOWS.format(closed=""))
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The gap of each hour, from the sums a stream keeps."""
    from fairloom.streaming.windows import gaps, windowed_group_sums

    e = _table(spark, d, "events").withColumn("y_pred", (F.col("value") > 10).cast("int"))
    return _windows(gaps(windowed_group_sums(e, "ts", "event_type", "y_pred"), 5))


@query(_WINDOWS.format(closed="where window_start + interval 1 hour <= (select max(ts) from events) - interval 10 minutes"))
def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream that reads all events once and writes each window when it has closed."""
    import uuid
    from pathlib import Path

    from fairloom.session import shared_dir
    from fairloom.streaming.windows import monitor

    src = Path(d, "events.parquet")
    schema = _table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    e = reader.parquet(str(src)) if src.is_dir() else reader.option("pathGlobFilter", src.name).parquet(d)
    at = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    q = monitor(e.withColumn("y_pred", (F.col("value") > 10).cast("int")), "ts", "event_type", "y_pred", f"{at}/out", f"{at}/state", min_group_size=5)
    q.awaitTermination()
    return _windows(spark.read.schema("window_start timestamp, dpd double, eod double, n_groups long").option("recursiveFileLookup", True).parquet(f"{at}/out"))
