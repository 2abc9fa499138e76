"""Queries of the data preparation operators of the core (problems 1, 2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.operators import hot_keys, nested
from fairloom.operators.drift import SchemaDrift
from fairloom.operators.profile import ColumnProfile, Rule, issues


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p5(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    return hot_keys.key_statistics(_table(spark, d, table), key, "score", ["y_true", "y_pred"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with more than 5 % of the rows, out of the statistics of all values."""
    parts = []
    for table, key in (("dev_sample", "sensitive"), ("e2e_sample", "group")):
        hot = hot_keys.hot_keys(_p5(spark, d, table, key), key)
        parts.append(hot.select(F.lit(table).alias("table_name"), F.col(f"`{key}`").alias("key_value")))
    return parts[0].unionByName(parts[1])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6 if c == "stddev" else 10).alias(c) if t == "double" and not c.startswith("p") else F.col(f"`{c}`") for c, t in df.dtypes])


def p5_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_p5(spark, d, "dev_sample", "sensitive"))


def p5_group(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_p5(spark, d, "e2e_sample", "group"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each file of both kinds of reports against the one before."""
    a, b = (SchemaDrift(_table(spark, d, t)).changes() for t in ("detectors", "pipeline_phase0_report"))
    return a.unionByName(b)


def p1_detectors(spark: SparkSession, d: str) -> DataFrame:
    """All detectors reports in one table."""
    return SchemaDrift(_table(spark, d, "detectors")).unified(["report_id", "feed_id", "file_id", "file_seq", "record_no"])


def p1_phase0(spark: SparkSession, d: str) -> DataFrame:
    return SchemaDrift(_table(spark, d, "pipeline_phase0_report")).unified(["report_id", "feed_id", "file_id", "file_seq", "record_no"])


# What the columns of dev_sample may hold.
RULES = {"score": Rule(low=0.0, high=1.0), "y_true": Rule(binary=True), "y_pred": Rule(binary=True), "sensitive": Rule(pattern=r"\A[A-H]([0-9]{3})?\z")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Issues of y_pred, score and sensitive, by load."""
    p = ColumnProfile(_table(spark, d, "dev_sample"), "load_id", RULES, ["score", "y_pred", "sensitive"]).profile()
    return issues(p, "load_id")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """All columns of dev_sample, by load."""
    return ColumnProfile(_table(spark, d, "dev_sample"), "load_id", RULES).profile()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and their slices, each row with its report and item."""
    rows = nested.link(nested.nodes(_table(spark, d, "detectors")))
    return rows.select("report_id", "section", "item_no", "slice_no", "attribute", "feature")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """The same with the intervals that link slices to items."""
    return nested.link(nested.nodes(_table(spark, d, "detectors")))


def p3_slice_values(spark: SparkSession, d: str) -> DataFrame:
    """The scalar values of slices, by the slice's interval."""
    return nested.values_of(nested.nodes(_table(spark, d, "detectors"), values=True), "slice")


QUERIES = [p1_found, p1_detectors, p1_phase0, p2_found, p2_profile, p3_found, p3_links, p3_slice_values, p5_found, p5_sensitive, p5_group]

_P5_FOUND = """select '{t}' as table_name, {k} as key_value from {t} where {k} is not null group by 2
having count(*) * 20 > (select count(*) from {t} where {k} is not null)"""
_P5 = """with v as (select {k}, y_true, y_pred, case when not isnan(score) then score end as s, case when not isnan(score) and not isinf(score) then score end as f from {t}),
r as (select {k}, s, row_number() over (partition by {k} order by s) as i, count(*) over (partition by {k}) as n from v where s is not null),
q as (select {k}, {points} from r group by 1),
a as (select {k}, count(*) as n_rows, count(s) as n_values, round(avg(f), 10) as mean, round(stddev_samp(f), 6) as stddev, round(min(s), 10) as least, round(max(s), 10) as greatest,
  round(avg(y_true), 10) as rate_y_true, round(avg(y_pred), 10) as rate_y_pred from v group by 1)
select a.*, {names} from a left join q on a.{k} is not distinct from q.{k}"""
_POINTS = ", ".join(f"max(case when i = greatest((n * {p} + 9999) // 10000, 1) then s end) as p{p}" for p in (2500, 5000, 7500))


def _p5_sql(t: str, k: str) -> str:
    return _P5.format(t=t, k=k, points=_POINTS, names="q.p2500, q.p5000, q.p7500")


_P2 = r"""with d as (select load_id, y_pred, sensitive, case when not isnan(score) then score end as score, case when not isnan(score) and score between 0 and 1 then score end as x,
  case when y_pred in (0, 1) then y_pred end as b, case when regexp_full_match(sensitive, '[A-H]([0-9]{3})?') then sensitive end as w from dev_sample),
a as (select load_id, count(*) as n, count(y_pred) as n1, count(score) as n2, count(sensitive) as n3, count(distinct y_pred) as k1, count(distinct score) as k2, count(distinct sensitive) as k3,
  count(case when y_pred not in (0, 1) then 1 end) as o1, count(case when score < 0 or score > 1 then 1 end) as o2, count(case when sensitive is not null and w is null then 1 end) as o3, avg(b) as m from d group by 1),
g as (select x, sum(count(*)) over (order by x) as g1, count(*) as gc from d where x is not null group by 1),
f as (select load_id, x, sum(count(*)) over (partition by load_id order by x) as f1, count(*) as fc from d where x is not null group by 1, 2),
ks as (select load_id, max(greatest(abs(f1 / fn - g1 / gn), abs((f1 - fc) / fn - (g1 - gc) / gn))) as gap from f join g using (x)
  join (select load_id, count(x) as fn from d group by 1) using (load_id), (select count(x) as gn from d) group by 1),
s as (select w, count(*) / (select count(w) from d) as share from d where w is not null group by 1),
l as (select load_id, count(w) as ln from d group by 1),
c as (select load_id, w, count(*) as lc from d where w is not null group by 1, 2),
sh as (select l.load_id, max(abs(coalesce(lc, 0) / ln - share)) as gap from l cross join s left join c on c.load_id = l.load_id and c.w = s.w where ln > 0 group by 1)
select load_id, 'y_pred' as column_name, 'nulls' as issue from a where (n - n1) * 100 > n * 8
union all select load_id, 'score', 'nulls' from a where (n - n2) * 100 > n * 8
union all select load_id, 'sensitive', 'nulls' from a where (n - n3) * 100 > n * 8
union all select load_id, 'y_pred', 'range' from a where o1 > 0
union all select load_id, 'score', 'range' from a where o2 > 0
union all select load_id, 'sensitive', 'pattern' from a where o3 > 0
union all select load_id, 'y_pred', 'constant' from a where k1 = 1
union all select load_id, 'score', 'constant' from a where k2 = 1
union all select load_id, 'sensitive', 'constant' from a where k3 = 1
union all select load_id, 'y_pred', 'shift' from a where abs(m - (select avg(b) from d)) > 0.15
union all select load_id, 'score', 'shift' from ks where gap > 0.15
union all select load_id, 'sensitive', 'shift' from sh where gap > 0.15"""

SQL = {
    "p2_found": _P2,
    "p5_found": _P5_FOUND.format(t="dev_sample", k="sensitive") + " union all " + _P5_FOUND.format(t="e2e_sample", k='"group"'),
    "p5_sensitive": _p5_sql("dev_sample", "sensitive"),
    "p5_group": _p5_sql("e2e_sample", '"group"'),
}
