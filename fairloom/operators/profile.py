"""Problem 2: a quality profile of every column for every load, and the loads that differ.

One pass of partial aggregates gives missing values, ranges and distinct counts per load. Text columns get expressions by minimum description length
over all distinct values (functions/expressions.py); rows that do not conform are malformed and counted per load, and each load's coverage is compared
with the table's. Where a column has an exact rule, it checks the expressions: one most of whose rows break the rule (a habit common enough for an
expression, but not allowed) is dropped, and single rows that break it count as malformed too. The change of a distribution is the largest gap between two cumulative distributions (numbers), the difference of a share (0/1 columns), or
the largest difference of a value's share (codes).

The gap of numbers is first bounded on a grid of CELLS cells, whose counts per load are all that is shuffled; only loads for which the bounds leave
the limit undecided are counted value by value, within the cells that matter. So decisions are exact, and the reported gap lies between shift and
shift_most.

Defined results: a NULL load is a load of its own; missing is NULL, and NaN in floating columns; infinities are values, and out of any range; repeated
rows count each; an empty table gives no rows; a load whose values are all missing has NULL range and shift. Columns are read only as named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.functions.expressions import column_expressions, whole
from fairloom.operators.selection import same_keys
from fairloom.session import broadcast_if_small, stage

CELLS = 256
#: Codes with at least this share of the table are compared also where a load lacks them: at most 100, and a smaller share is a smaller difference.
HEAVY = 0.01


@dataclass(frozen=True)
class Rule:
    """What a column may hold: low..high for numbers, a 0/1 column, or an exact expression for codes."""

    low: float | None = None
    high: float | None = None
    binary: bool = False
    pattern: str | None = None


@dataclass(frozen=True)
class Limits:
    null_percent: int = 8
    shift: float = 0.15


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col.isNull()


def _number(df: DataFrame, c: str) -> Column | None:
    """The column as a double that grows with it; None for kinds without an order on a line."""
    col, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType)):
        return col.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # as if in UTC: a zone's clock changes would break the order
        return (F.unix_date(col.cast("date")) * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)).cast("double")
    return None


class ColumnProfile:
    def __init__(self, df: DataFrame, load: str, rules: dict[str, Rule], columns: list[str] | None = None, limits: Limits = Limits()):
        self.df, self.load, self.rules, self.limits = df, load, rules, limits
        self.columns = columns or [c for c in df.columns if c != load]
        self.key = F.col(f"`{load}`").alias("load__")

    def _basics(self) -> DataFrame:
        """One row per load: for column i the number missing, least, greatest, about how many distinct, and out of range."""
        aggs = [F.count("*").alias("n__")]
        for i, c in enumerate(self.columns):
            gone, col, rule = _missing(self.df, c), F.col(f"`{c}`"), self.rules.get(c, Rule())
            there = F.when(~gone, col)
            aggs += [F.count(F.when(gone, 1)).alias(f"gone{i}"), F.min(there).cast("string").alias(f"least{i}"), F.max(there).cast("string").alias(f"most{i}"), (F.min(there) == F.max(there)).alias(f"one{i}"), F.approx_count_distinct(there, 0.05).alias(f"kinds{i}")]
            bad = ~there.isin(0, 1) if rule.binary else (there < rule.low) | (there > rule.high) if rule.low is not None else F.lit(False)
            aggs.append(F.count(F.when(bad, 1)).alias(f"bad{i}"))
            if rule.binary:
                aggs += [F.count(F.when(there == 1, 1)).alias(f"ones{i}"), F.count(F.when(there.isin(0, 1), 1)).alias(f"bits{i}")]
        return self.df.groupBy(self.key).agg(*aggs)

    def _codes(self, c: str, rule: Rule) -> DataFrame:
        """(load__, odd, malformed, coverage, coverage_table, shift) of a text column."""
        col = F.col(f"`{c}`")
        v = stage(self.df.where(col.isNotNull()).groupBy(self.key, col.alias("v__")).agg(F.count("*").alias("c__")))
        expressions = column_expressions(v.groupBy("v__").agg(F.sum("c__").alias("c__")), "v__", "c__")
        legal = F.col("v__").rlike(rule.pattern) if rule.pattern else F.lit(True)
        if rule.pattern and expressions:
            of = [F.col("v__").rlike(whole([e])) for e in expressions]
            n = v.agg(*[F.sum(F.when(e & ok, F.col("c__")).otherwise(0)) for e in of for ok in (legal, ~legal)]).first()
            expressions = [e for i, e in enumerate(expressions) if n[2 * i] >= n[2 * i + 1]]
        v = v.withColumn("fits__", F.col("v__").rlike(whole(expressions)))
        v = v.withColumn("good__", F.col("fits__") & legal)
        all_, fit = v.agg(F.sum("c__"), F.sum(F.when(F.col("fits__"), F.col("c__")))).first()
        count = lambda c: F.sum(F.when(~F.col(c), F.col("c__")).otherwise(0))
        out = v.groupBy("load__").agg(count("fits__").alias("odd"), count("good__").alias("malformed"), (1 - count("fits__") / F.sum("c__")).alias("coverage"), F.sum(F.when(F.col("good__"), F.col("c__"))).alias("good__"))
        out = out.withColumn("coverage_table", F.lit((fit or 0) / all_ if all_ else None).cast("double"))
        well = v.where("good__").select("load__", "v__", "c__")
        whole_n = well.agg(F.sum("c__")).first()[0] or 1
        share = stage(well.groupBy("v__").agg((F.sum("c__") / whole_n).alias("share__")))
        heavy = [(r[0], r[1]) for r in share.where(F.col("share__") >= HEAVY).collect()]  # at most 1 / HEAVY codes
        own = well.join(out.select(F.col("load__").alias("m_load__"), F.col("good__").alias("g__")), same_keys(["load__"])).join(share, "v__")
        own = own.select("load__", "v__", F.abs(F.col("c__") / F.col("g__") - F.col("share__")).alias("d__"))
        if heavy:
            must = F.explode(F.array(*[F.struct(F.lit(a).alias("v__"), F.lit(s).alias("d__")) for a, s in heavy]))
            every = out.where("good__ > 0").select("load__", must.alias("h")).select("load__", "h.v__", "h.d__")
            lacking = every.join(own.select(F.col("load__").alias("m_load__"), F.col("v__").alias("m_v__")), same_keys(["load__", "v__"]), "left_anti")
            own = own.unionByName(lacking)
        gap = own.groupBy(F.col("load__").alias("m_load__")).agg(F.max("d__").alias("shift"))
        return out.join(gap, same_keys(["load__"]), "left").select("load__", "odd", "malformed", "coverage", "coverage_table", "shift")

    def _gaps(self, c: str, rule: Rule) -> DataFrame:
        """(load__, shift, shift_most): bounds of the gap between the load's and the table's distribution of values in range, without a
        rule of finite ones. The grid then spans the middle of the table, so that a few values far off don't make it coarse."""
        x, low, high = _number(self.df, c), rule.low, rule.high
        if low is None:
            inside = ~_missing(self.df, c) & (F.abs(x) < float("inf"))
            ends = self.df.where(inside).agg(F.percentile_approx(x, [0.02, 0.98], 1000)).first()[0]
            low, high = ends or (0.0, 0.0)
        else:
            inside = ~_missing(self.df, c) & (x >= low) & (x <= high)
        # halves, as the whole width may be no finite number
        width = high / 2 - low / 2
        cell = F.when(x < low, -1).when(x > high, CELLS + 1).otherwise(F.floor((x / 2 - low / 2) / width * CELLS) if width else 0).cast("int")
        rows = self.df.where(inside).select(self.key, F.col(f"`{c}`").alias("x__"), cell.alias("cell__"))
        per = stage(rows.groupBy("load__", "cell__").agg(F.count("*").alias("c__")))
        table = [tuple(r) for r in per.groupBy("cell__").agg(F.sum("c__")).orderBy("cell__").collect()]  # at most CELLS + 3 rows
        n, before, cum = sum(k for _, k in table), [], 0
        for i, k in table:
            before.append((i, cum, cum + k))
            cum += k
        edges = F.broadcast(self.df.sparkSession.createDataFrame(before, "cell__ int, g0__ long, g1__ long"))
        w = Window.partitionBy("load__")
        per = per.withColumn("n__", F.sum("c__").over(w)).withColumn("f1__", F.sum("c__").over(w.orderBy("cell__").rowsBetween(Window.unboundedPreceding, 0)))
        d = per.join(edges, "cell__").select("load__", "cell__", "n__", (F.col("f1__") - F.col("c__")).alias("f0__"), "f1__", "g0__", (F.col("f1__") / F.col("n__")).alias("F1"), ((F.col("f1__") - F.col("c__")) / F.col("n__")).alias("F0"), (F.col("g0__") / max(n, 1)).alias("G0"), (F.col("g1__") / max(n, 1)).alias("G1"))
        d = stage(d.withColumn("low__", F.greatest(F.abs(F.col("F1") - F.col("G1")), F.abs(F.col("F0") - F.col("G0")))).withColumn("high__", F.greatest(F.col("F1") - F.col("G0"), F.col("G1") - F.col("F0"), "low__")))
        bounds = d.groupBy("load__").agg(F.max("low__").alias("shift"), F.max("high__").alias("shift_most"))
        limit = self.limits.shift
        unsure = stage(d.join(bounds.where((F.col("shift") <= limit) & (F.col("shift_most") > limit)).select(F.col("load__").alias("m_load__")), same_keys(["load__"]), "left_semi").where(F.col("high__") > limit))
        cells, k = unsure.agg(F.collect_set("cell__"), F.count("*")).first()
        if not k:
            return bounds
        near = rows.where(F.col("cell__").isin(cells))
        grown = near.groupBy("cell__", "x__").agg(F.count("*").alias("c__")).withColumn("g__", F.sum("c__").over(Window.partitionBy("cell__").orderBy("x__").rowsBetween(Window.unboundedPreceding, 0)))
        marks = broadcast_if_small(unsure.select(F.col("load__").alias("m_load__"), F.col("cell__").alias("m_cell__"), "n__", "f0__", "g0__"), k)
        own = near.join(marks, same_keys(["load__", "cell__"])).groupBy("load__", "cell__", "x__", "n__", "f0__", "g0__").agg(F.count("*").alias("o__"))
        own = own.withColumn("f__", F.sum("o__").over(Window.partitionBy("load__", "cell__").orderBy("x__").rowsBetween(Window.unboundedPreceding, 0)))
        own = own.join(grown.select(F.col("x__").alias("y__"), "c__", "g__"), F.col("x__") == F.col("y__"))
        upto = F.abs((F.col("f0__") + F.col("f__")) / F.col("n__") - (F.col("g0__") + F.col("g__")) / n)
        under = F.abs((F.col("f0__") + F.col("f__") - F.col("o__")) / F.col("n__") - (F.col("g0__") + F.col("g__") - F.col("c__")) / n)
        exact = own.groupBy(F.col("load__").alias("m_load__")).agg(F.max(F.greatest(upto, under)).alias("exact__"))
        # cells left out are below the limit by their upper bound; where the exact gap is too, it and they bound the load's gap
        rest = F.when(F.col("exact__").isNull(), F.col("shift_most")).otherwise(F.greatest("exact__", F.least("shift_most", F.lit(limit))))
        return bounds.join(exact, same_keys(["load__"]), "left").select("load__", F.greatest("shift", "exact__").alias("shift"), rest.alias("shift_most"))

    def profile(self) -> DataFrame:
        """One row per load and column: load, column_name, n_rows, n_missing, n_distinct (about 5 % off), least, greatest, n_out_of_range, n_odd,
        n_malformed, coverage, coverage_table, shift, shift_most, and the issues as flags nulls, range, pattern, constant, shifted, and uncovered: the
        expressions cover less of the load than of the table by more than the limit of shifts."""
        basics = stage(self._basics())
        limit, parts = self.limits, []
        none = F.lit(None).cast("double")
        for i, c in enumerate(self.columns):
            rule = self.rules.get(c, Rule())
            b = basics.select("load__", F.col("n__").alias("n_rows"), F.col(f"gone{i}").alias("n_missing"), F.col(f"kinds{i}").alias("n_distinct"), F.col(f"least{i}").alias("least"), F.col(f"most{i}").alias("greatest"), F.col(f"bad{i}").alias("n_out_of_range"), F.col(f"one{i}").alias("one"), *([f"ones{i}", f"bits{i}"] if rule.binary else []))
            if isinstance(self.df.schema[c].dataType, T.StringType):
                e = self._codes(c, rule).withColumnRenamed("load__", "m_load__")
                b = b.join(e, same_keys(["load__"]), "left").withColumn("shift_most", F.col("shift"))
            else:
                b = b.withColumns({"odd": F.lit(0).cast("long"), "malformed": F.lit(0).cast("long"), "coverage": none, "coverage_table": none})
                if rule.binary:
                    ones, bits = basics.agg(F.sum(f"ones{i}"), F.sum(f"bits{i}")).first()
                    gap = F.abs(F.try_divide(f"ones{i}", f"bits{i}") - F.lit((ones or 0) / (bits or 1)))
                    b = b.withColumn("shift", gap).withColumn("shift_most", gap)
                elif _number(self.df, c) is not None:
                    b = b.join(self._gaps(c, rule).withColumnRenamed("load__", "m_load__"), same_keys(["load__"]), "left")
                else:
                    b = b.withColumns({"shift": none, "shift_most": none})
            parts.append(
                b.select(
                    F.col("load__").alias(self.load), F.lit(c).alias("column_name"), "n_rows", "n_missing", F.when(F.col("one"), F.lit(1).cast("long")).otherwise(F.col("n_distinct")).alias("n_distinct"), "least", "greatest", "n_out_of_range", F.coalesce("odd", F.lit(0)).alias("n_odd"), F.coalesce("malformed", F.lit(0)).alias("n_malformed"), "coverage", "coverage_table", "shift", "shift_most",
                    (F.col("n_missing") * 100 > F.col("n_rows") * limit.null_percent).alias("nulls"), (F.col("n_out_of_range") > 0).alias("range"), (F.coalesce("malformed", F.lit(0)) > 0).alias("pattern"), F.coalesce("one", F.lit(False)).alias("constant"), F.coalesce(F.col("shift") > limit.shift, F.lit(False)).alias("shifted"), F.coalesce(F.col("coverage_table") - F.col("coverage") > limit.shift, F.lit(False)).alias("uncovered"),
                )
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def issues(profile: DataFrame, load: str) -> DataFrame:
    """(load, column_name, issue): the flags of a profile that are set, but for uncovered."""
    names = {"nulls": "nulls", "range": "range", "pattern": "pattern", "constant": "constant", "shifted": "shift"}
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in names.items()]))
    return profile.select(F.col(f"`{load}`"), "column_name", F.explode(found).alias("issue"))
