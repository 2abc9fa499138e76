"""Problem 6: a sample of each plan's load with given shares of categories, by systematic unequal-probability sampling.

A category's distinct records are put in random order (a seeded hash of the record), categories in sorted order; every record has the inclusion
probability share * size / available (at most 1). The running sum of the probabilities is known from the category's offset and the record's rank, so
prefix sums need no pass over all rows of a plan: ranks are counted within hash buckets of a category and shifted by the buckets' sums. From one
random start per plan the records at whose place the running sum crosses a whole step are drawn. Floors are repaired afterwards: a category below
the larger of its minimum and its rounded share gets the next records of its random order; the report tells what the load could not give.

All sums are whole numbers (hundredths of a record), so results do not depend on partitioning.

Defined results: a category is taken exactly as written, a NULL category matches NULL; a record that comes repeatedly counts once in each category it
is stored with; NULL record ids are not drawn; a NULL share, size or minimum is 0; a plan whose load is missing or NULL gets an empty sample and is
reported; empty tables give empty results; repeated target rows count once (the largest wish is kept). Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.session import stage

#: Records of one category that one task ranks, about; larger categories are split into hash buckets.
BUCKET_ROWS = 200_000


class StratifiedSample:
    def __init__(self, rows: DataFrame, targets: DataFrame, categories: list[str], record: str = "rec_id", stratum: str = "load_id", plan: str = "plan_id", size: str = "sample_size", share: str = "target_share", minimum: str = "min_rows", seed: int = 42):
        cats = [f"c{i}__" for i in range(len(categories))]
        self.categories, self.cats, self.plan, self.record, self.stratum, self.seed = categories, cats, plan, record, stratum, seed
        named = [F.col(c).alias(k) for c, k in zip(categories, cats)]
        t = targets.select(F.col(plan).alias("plan__"), F.col(stratum).alias("load__"), *named, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size__"), F.coalesce(F.rint(F.col(share) * 100).cast("long"), F.lit(0)).alias("pct__"), F.coalesce(F.col(minimum).cast("long"), F.lit(0)).alias("min__"))
        t = t.groupBy("plan__", "load__", *cats).agg(F.max("size__").alias("size__"), F.max("pct__").alias("pct__"), F.max("min__").alias("min__"))
        self.targets = t.withColumn("need__", F.greatest("min__", F.rint(F.col("pct__") * F.col("size__") / 100).cast("long")))
        wanted = self.targets.where("load__ is not null").select("load__", *cats).distinct()
        r = rows.select(F.col(stratum).alias("load__"), *named, F.col(record).alias("rec__")).where("load__ is not null and rec__ is not null")
        u, w = r.alias("u"), wanted.alias("w")
        on = F.col("u.load__") == F.col("w.load__")
        for c in cats:
            on = on & F.col(f"u.{c}").eqNullSafe(F.col(f"w.{c}"))
        # only records of categories that some plan wants, each once
        self.units = stage(u.join(w, on, "left_semi").distinct())
        self.available = stage(self.units.groupBy("load__", *cats).agg(F.count("*").alias("avail__")))

    def _match(self, left: DataFrame, right: DataFrame, how: str, also: tuple[str, ...] = ("load__",)) -> DataFrame:
        """Equi-join on also and the categories, NULLs equal; the right's keys go."""
        keys = [*also, *self.cats]
        right = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return left.join(right, on, how).drop(*[f"r_{k}" for k in keys])

    def _planned(self) -> DataFrame:
        """Targets with the records available, expected hundredths, their running sum in the plan, and the plan's start."""
        p = self._match(self.targets, self.available, "left").withColumn("avail__", F.coalesce("avail__", F.lit(0)))
        p = p.withColumn("expect__", F.least(F.col("pct__") * F.col("size__"), F.col("avail__") * 100))
        before = Window.partitionBy("plan__").orderBy("load__", *self.cats).rowsBetween(Window.unboundedPreceding, -1)
        p = p.withColumn("off__", F.coalesce(F.sum("expect__").over(before), F.lit(0)))
        return p.withColumn("start__", F.pmod(F.xxhash64(F.lit(self.seed), "plan__"), F.lit(100)))

    def _ranked(self) -> DataFrame:
        """Records with their random rank (from 1) in their category."""
        small = self.available.select("load__", *self.cats, "avail__").withColumn("split__", F.expr(f"avail__ div {BUCKET_ROWS} + 1"))
        u = self._match(self.units, small.drop("avail__"), "inner").withColumn("h__", F.xxhash64(F.lit(self.seed), "rec__"))
        u = u.withColumn("b__", F.expr("(shiftrightunsigned(h__, 33) * split__) div 2147483648"))
        w = Window.partitionBy("load__", *self.cats, "b__").orderBy("h__", "rec__")
        u = u.withColumn("i__", F.row_number().over(w).cast("long"))
        # buckets' sums of the categories that have more than one
        sums = u.where("split__ > 1").groupBy("load__", *self.cats, "b__").agg(F.count("*").alias("n__"))
        ahead = Window.partitionBy("load__", *self.cats).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("load__", *self.cats, "b__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("ahead__"))
        if not self.available.where(f"avail__ >= {BUCKET_ROWS}").limit(1).count():
            return u
        return self._match(u, sums, "left", ("load__", "b__")).withColumn("i__", F.col("i__") + F.coalesce("ahead__", F.lit(0)))

    def drawn(self) -> DataFrame:
        """(plan, stratum, categories, record, how): the sample; how is 'systematic' or 'floor'."""
        p = self._planned().where("avail__ > 0")
        r = self._match(self._ranked().select("load__", *self.cats, "rec__", "i__"), p, "inner")
        # steps passed up to the record, the one before, the category's start and end; all counted from the same shift so that none is negative
        passed = lambda i: F.expr(f"(off__ * avail__ + expect__ * ({i}) + (100 - start__) * avail__) div (100 * avail__)")
        r = r.withColumn("now__", passed("i__")).withColumn("was__", passed("i__ - 1")).withColumn("first__", passed("0")).withColumn("last__", passed("avail__"))
        r = r.withColumn("lack__", F.least("avail__", "need__") - (F.col("last__") - F.col("first__")))
        hit = F.col("now__") > F.col("was__")
        # place among the category's records that were not hit
        spare = F.col("i__") - (F.col("was__") - F.col("first__"))
        r = r.withColumn("how", F.when(hit, "systematic").when(spare <= F.col("lack__"), "floor")).where("how is not null")
        return r.select(F.col("plan__").alias(self.plan), F.col("load__").alias(self.stratum), *[F.col(k).alias(c) for c, k in zip(self.categories, self.cats)], F.col("rec__").alias(self.record), "how")

    def report(self) -> DataFrame:
        """Each target row with the share and records wanted, those available and drawn, and unmet: drawn < wanted; and of its plan the size, all records drawn
        (total), the share of them that this row has (share_drawn, NULL in an empty sample), and minima_exceed: the rows' wishes together are more than the size;
        most_by_share is the expected number rounded up, which systematic sampling can reach.

        A minimum above the share comes on top of the size, and what a load lacks is not drawn from other categories, so total can be above or below the size.
        """
        named = [F.col(k).alias(c) for c, k in zip(self.categories, self.cats)]
        back = [F.col(c).alias(k) for c, k in zip(self.categories, self.cats)]
        d = self.drawn().select(F.col(self.plan).alias("plan__"), F.col(self.stratum).alias("load__"), *back).groupBy("plan__", "load__", *self.cats).agg(F.count("*").alias("drawn__"))
        p = self._match(self._planned(), d, "left", ("plan__", "load__")).withColumn("drawn__", F.coalesce("drawn__", F.lit(0)))
        whole = Window.partitionBy("plan__")  # a plan's target rows, not its records
        p = p.withColumn("total__", F.sum("drawn__").over(whole)).withColumn("needs__", F.sum("need__").over(whole)).withColumn("size__", F.max("size__").over(whole))
        return p.select(
            F.col("plan__").alias(self.plan), F.col("load__").alias(self.stratum), *named, (F.col("pct__") / 100).alias("share_wanted"), F.try_divide("drawn__", "total__").alias("share_drawn"),
            F.col("need__").alias("wanted"), F.col("avail__").alias("available"), F.col("drawn__").alias("drawn"), (F.col("drawn__") < F.col("need__")).alias("unmet"),
            F.col("size__").alias("size"), F.col("total__").alias("total"), (F.col("needs__") > F.col("size__")).alias("minima_exceed"), F.least("avail__", F.ceil(F.col("expect__") / 100)).alias("most_by_share"),
        )
