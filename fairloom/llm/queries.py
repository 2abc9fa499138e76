"""The queries of the llm operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairloom.llm import bpe, packing, percentiles, sampling, truncation

POINTS = [100, 500, 1000, 2500, 5000, 7500, 9000, 9500, 9900]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of score per sensitive group."""
    return percentiles.radix_percentiles(_table(spark, d, "dev_sample"), ["sensitive"], "score", POINTS)


def p4_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """States of single loads put together: percentiles per group between two bounds."""
    state = percentiles.percentile_state(_table(spark, d, "dev_sample"), ["load_id", "sensitive"], "score", 20)
    return percentiles.percentiles_of_state(percentiles.merge_states(state, ["sensitive"]), ["sensitive"], POINTS)


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    """The same by day of the load, for the median; states of loads meet their day through load_log."""
    state = percentiles.percentile_state(_table(spark, d, "dev_sample"), ["load_id"], "score", 20)
    days = state.join(_table(spark, d, "load_log").select("load_id", "load_day"), "load_id")
    return percentiles.percentiles_of_state(percentiles.merge_states(days, ["load_day"]), ["load_day"], [5000])


def _sample(spark: SparkSession, d: str) -> sampling.StratifiedSample:
    return sampling.StratifiedSample(_table(spark, d, "dev_sample"), _table(spark, d, "sample_targets"), ["sensitive", "y_true"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets the drawn sample falls short of because the load holds too few records."""
    r = _sample(spark, d).report().where("unmet and available < wanted")
    return r.select("plan_id", "sensitive", "y_true")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).drawn()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The drawn records of each target row are those wanted, or what the load has, or at most the expected number rounded up."""
    r = _sample(spark, d).report()
    least = F.least("wanted", "available")
    return r.select("plan_id", "sensitive", "y_true", "size", "wanted", "available", "minima_exceed", (F.col("drawn").between(least, F.greatest(least, "most_by_share"))).alias("as_wanted"), F.round("share_wanted", 2).alias("share_wanted"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, d, "documents"))


def _packing(spark: SparkSession, d: str) -> packing.Packing:
    return packing.Packing(bpe.token_counts(_table(spark, d, "documents")), _table(spark, d, "containers"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of each document with its container, for every kind of container."""
    return _packing(spark, d).assignments()


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).summary()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored text breaks off."""
    return truncation.Truncation(_table(spark, d, "documents")).judged().where("truncated").select("doc_id")


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.Truncation(_table(spark, d, "documents")).judged()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.Truncation(_table(spark, d, "documents")).rates()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_percentiles, p4_merged_loads, p4_days, p6_found, p6_sample, p6_report, p6_counts, p7_ids, p8_packed, p8_summary, p9_found, p9_judged, p9_rates)}


_RANKED = """select {key}, score, row_number() over (partition by {key} order by score) as i, count(*) over (partition by {key}) as n
from {source} where score is not null and not isnan(score)"""
_P4 = f"""with r as ({_RANKED.format(key="sensitive", source="dev_sample")}), p as (select unnest({POINTS}) as p_bp)
select sensitive, p_bp, n, score as value from r join p on i = greatest((n * p_bp + 9999) // 10000, 1)"""
_NEED = "greatest(max(coalesce(min_rows, 0)), cast(round(max(target_share) * 100) * max(sample_size) / 100 as bigint))"
_P6 = f"""with t as (select plan_id, load_id, sensitive, y_true, cast({_NEED} as bigint) as wanted from sample_targets group by all),
a as (select load_id, sensitive, y_true, count(distinct rec_id) as available from dev_sample group by all),
r as (select t.*, coalesce(a.available, 0) as available from t left join a
  on t.load_id = a.load_id and t.sensitive is not distinct from a.sensitive and t.y_true is not distinct from a.y_true)"""


# a bucket is what the leading 20 bits of a double have in common, taken from its bits as a signed whole number
_STATE = """with v as (select {key}, case when score = 0 then 0.0 else score end as x from {source} where score is not null and not isnan(score)),
e as (select *, abs(x) as a, case when x <> 0 and not isinf(x) then cast(floor(log2(abs(x))) as integer) end as e0 from v),
f as (select {key}, x, a, e0 + case when a >= pow(2.0, e0 + 1) then 1 when a < pow(2.0, e0) then -1 else 0 end as e from e),
k as (select {key}, x, case when isinf(x) then 2047 * 4503599627370496 when x = 0 then 0 else (e + 1023) * 4503599627370496 + cast((a / pow(2.0, e) - 1) * 4503599627370496 as bigint) end as b from f),
b as (select {key}, x, case when x >= 0 then b // 17592186044416 else -((b + 17592186044415) // 17592186044416) end as bucket from k),
r as (select {key}, x, bucket, row_number() over (partition by {key} order by x) as i, count(*) over (partition by {key}) as n,
  min(x) over (partition by {key}, bucket) as lower, max(x) over (partition by {key}, bucket) as upper from b), p as (select unnest({points}) as p_bp)
select {key}, p_bp, n, lower, upper from r join p on i = greatest((n * p_bp + 9999) // 10000, 1)"""
_P6_COUNTS = f"""{_P6} select r.plan_id, r.sensitive, r.y_true, s.size, r.wanted, r.available, s.needs > s.size as minima_exceed, true as as_wanted, s2.share_wanted from r
join (select plan_id, cast(max(sample_size) as bigint) as size, sum(wanted) as needs from r join (select distinct plan_id, sample_size from sample_targets) using (plan_id) group by 1) s using (plan_id)
join (select plan_id, sensitive, y_true, round(max(target_share), 2) as share_wanted from sample_targets group by all) s2
  on r.plan_id = s2.plan_id and r.sensitive is not distinct from s2.sensitive and r.y_true is not distinct from s2.y_true"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_percentiles": _P4,
        "p4_merged_loads": _STATE.format(key="sensitive", source="dev_sample", points=POINTS),
        "p4_days": _STATE.format(key="load_day", source="(select load_day, score from dev_sample join load_log using (load_id))", points=[5000]),
        "p6_found": f"{_P6} select plan_id, sensitive, y_true from r where available < wanted",
        "p6_counts": _P6_COUNTS,
    }
