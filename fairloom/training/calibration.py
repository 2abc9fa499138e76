"""Calibration of scores per group, without gathering a group.

Rows are first counted into (group, score) cells, which everything else reads. Platt scaling takes Newton steps whose sums are one grouped aggregate for all
groups. Isotonic regression pools adjacent violators within parts of each group's cells, which are put in order by ranges; of the blocks that are left only
those that overlap with other parts' means are pooled again, the others are final. Scores are looked up by binary search in the knots, without moving the
rows; where these are too many, by search in some of them and a join with the knots in between.

Defined results: rows with a missing or infinite score, a missing group or a label other than 0 and 1 are not learnt from; groups below min_samples, and
for Platt groups with one class, keep their scores; NULL and NaN scores stay NULL, scores beyond the knots get the outermost value.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairloom.functions.scalar import clip, sigmoid
from fairloom.operators.grouping import finite, without_nan
from fairloom.operators.prefix import running_sum
from fairloom.operators.selection import same_keys
from fairloom.session import broadcast_if_small, stage

METHODS = ("platt", "isotonic")


def pool_onto(out: list[list[float]], x0: Iterable[float], x1: Iterable[float], w: Iterable[float], y: Iterable[float]) -> None:
    """Continue out, blocks (from, to, weight, mean) with rising means, by blocks in order."""
    for a, b, n, m in zip(x0, x1, w, y):
        out.append([a, b, n, m])
        while len(out) > 1 and out[-2][3] >= out[-1][3]:
            a2, b2, n2, m2 = out.pop()
            p = out[-1]
            p[3] = (p[3] * p[2] + m2 * n2) / (p[2] + n2)
            p[1], p[2] = b2, p[2] + n2


def pool_adjacent(x0: np.ndarray, x1: np.ndarray, w: np.ndarray, y: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (from, to, weight, mean) with rising means from blocks in order."""
    out: list[list[float]] = []
    pool_onto(out, *(v.tolist() for v in (x0, x1, w, y)))
    return [tuple(b) for b in out]


def places(groups: list[str], first: np.ndarray, at: np.ndarray, g: pa.Array, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last entry, in order of group and at, that is not after each (g, x), -1 before all; and the first one of g, beyond it where g has none."""
    d = g.dictionary_encode()
    names = d.dictionary.to_pylist()
    i = np.array([bisect_left(groups, name) for name in names], dtype=np.int64)
    there = np.array([k < len(groups) and groups[k] == name for k, name in zip(i.tolist(), names)], dtype=np.int64)
    code = d.indices.to_numpy()
    least = lo = first[i][code]
    hi = first[i + there][code]
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        up = at[mid] <= x
        lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo - 1, least


def between(x: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """y at x on the line from x0 to x1, one of which may be infinite where it is level."""
    with np.errstate(all="ignore"):
        h = np.where(np.isinf(x1 - x0), 0.5, 1.0)  # finite ends can be an infinite length apart
        return np.where(y0 == y1, y0, y0 + (x * h - x0 * h) / (x1 * h - x0 * h) * (y1 - y0))


def _sorted_list(k: list[tuple[str, float]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Groups, where each begins (with the end of all), and values of sorted (group, value)."""
    groups = [g for g, _ in groupby(g for g, _ in k)]
    first = np.cumsum([0, *(sum(1 for _ in v) for _, v in groupby(g for g, _ in k))])
    return groups, first, np.array([x for _, x in k])


def _where_valid(of: Callable[..., np.ndarray], kind: pa.DataType, *cols: pa.Array) -> pa.Array:
    """of(cols) where none of them is missing; numbers as arrays, NaN is missing in the result."""
    ok = reduce(pc.and_, [c.is_valid() for c in cols])
    got = of(*[c if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_numpy() for c in (c.filter(ok) for c in cols)])
    there = ok.to_numpy(zero_copy_only=False)
    out = np.zeros(len(there), got.dtype)
    out[there] = got
    there[there] = ~np.isnan(got)
    return pa.array(out, kind, mask=~there)


class GroupFairnessCalibrator:
    """part: cells of a group that one task pools at a time; bound: knots that one task holds to look up scores."""

    def __init__(self, method: str = "platt", min_samples: int = 20, part: int = 50_000, steps: int = 25, l2: float = 1.0, bound: int = 200_000):
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        self.method, self.min_samples, self.part, self.steps, self.l2, self.bound = method, min_samples, part, steps, l2, bound

    def fit(self, df: DataFrame, score: str = "score", y: str = "y", group: str = "g") -> GroupFairnessCalibrator:
        self.score, self.group = score, group
        rows = df.select(without_nan(df, group).cast("string").alias("g"), finite(df, score).alias("x"), F.col(f"`{y}`").cast("double").alias("y")).dropna().where("y in (0, 1)")
        cells = rows.groupBy("g", "x").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("s"))
        self.model = self._platt(stage(cells)) if self.method == "platt" else self._isotonic(cells)
        return self

    def _platt(self, cells: DataFrame) -> DataFrame:
        """(m_g, a, b) with sigmoid(a x + b); the slope has an l2 penalty."""
        size = cells.groupBy("g").agg(F.sum("w").alias("n"), (F.sum("s") / F.sum("w")).alias("m")).where((F.col("n") >= self.min_samples) & (F.col("m") > 0) & (F.col("m") < 1))
        now = stage(size.select(F.col("g").alias("m_g"), F.lit(0.0).alias("a"), F.log(F.col("m") / (1 - F.col("m"))).alias("b")))
        k = now.count()
        for _ in range(self.steps):
            r = cells.join(broadcast_if_small(now, k), F.col("g") == F.col("m_g"))
            p = sigmoid(clip(F.col("a") * F.col("x") + F.col("b"), -500.0, 500.0))
            w, e = F.col("w") * p * (1 - p), F.col("w") * p - F.col("s")
            s = r.groupBy("m_g", "a", "b").agg(F.sum(e * F.col("x")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb"))
            s = s.withColumn("ga", F.col("ga") + self.l2 * F.col("a")).withColumn("haa", F.col("haa") + self.l2)
            det = F.col("haa") * F.col("hbb") - F.col("hab") ** 2
            da, db = F.try_divide(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb"), det), F.try_divide(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga"), det)
            short = F.least(F.lit(1.0), F.try_divide(F.lit(5.0), F.greatest(F.abs(da), F.abs(db))))
            move = [F.coalesce(d * F.coalesce(short, F.lit(1.0)), F.lit(0.0)) for d in (da, db)]
            nxt = stage(s.select("m_g", (F.col("a") - move[0]).alias("a"), (F.col("b") - move[1]).alias("b"), F.greatest(F.abs(move[0]), F.abs(move[1])).alias("d")))
            moved = nxt.agg(F.max("d")).first()[0]
            now = nxt.drop("d")
            if moved is None or moved < 1e-9:
                break
        return now

    def _isotonic(self, cells: DataFrame) -> DataFrame:
        """(m_g, x, y): each group's knots."""
        schema = "m_g string, part double, x0 double, x1 double, w double, y double"
        names, size = [c.split()[0] for c in schema.split(", ")], self.part
        ordered = cells.select(F.col("g").alias("m_g"), "x", "w", (F.col("s") / F.col("w")).alias("y")).repartitionByRange("m_g", "x").sortWithinPartitions("m_g", "x")

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A part is at most size cells of one group in one range, and is named by its first score."""
            group, part, n, open_ = None, 0.0, 0, []
            for t in batches:
                if not t.num_rows:
                    continue
                g = t.column("m_g").dictionary_encode()
                code = g.indices.to_numpy()
                bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
                x, w, y = (t.column(c).to_numpy().tolist() for c in ("x", "w", "y"))
                done = []
                for a, end in pairwise(bounds):
                    name = g.dictionary[int(code[a])].as_py()
                    while a < end:
                        if name != group or n == size:
                            done += [(group, part, *b) for b in open_]
                            group, part, n, open_ = name, x[a], 0, []
                        b = min(end, a + size - n)
                        pool_onto(open_, x[a:b], x[a:b], w[a:b], y[a:b])
                        a, n = b, n + b - a
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
            if open_:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(group, part, *b) for b in open_])], names)

        def again(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("x0")
            b = pool_adjacent(p["x0"].to_numpy(), p["x1"].to_numpy(), p["w"].to_numpy(), p["y"].to_numpy())
            return pd.DataFrame([(p["m_g"].iloc[0], p["part"].iloc[0], *x) for x in b], columns=p.columns)

        blocks = stage(ordered.mapInArrow(pool, schema))
        ends = blocks.groupBy(F.col("m_g").alias("e_g"), F.col("part").alias("e_part")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("w").alias("n"))
        by = Window.partitionBy("e_g")  # one row for each part
        # frames that begin with the partition are read once, those that end with it once for every row
        upto = Window.unboundedPreceding
        before = F.max("hi").over(by.orderBy("e_part").rowsBetween(upto, -1))
        after = F.min("lo").over(by.orderBy(F.desc("e_part")).rowsBetween(upto, -1))
        ends = ends.select("e_g", "e_part", before.alias("before"), after.alias("after"), F.sum("n").over(by).alias("n")).where(F.col("n") >= self.min_samples)
        b = blocks.join(ends, (F.col("m_g") == F.col("e_g")) & (F.col("part") == F.col("e_part")))
        over = F.coalesce(F.col("y") <= F.col("before"), F.lit(False)) | F.coalesce(F.col("y") >= F.col("after"), F.lit(False))
        b = b.where(~over).select(*blocks.columns).unionByName(b.where(over).select(*blocks.columns).groupBy("m_g").applyInPandas(again, schema))
        knots = F.when(F.col("x0") < F.col("x1"), F.array("x0", "x1")).otherwise(F.array("x0"))
        return stage(b.select("m_g", F.explode(knots).alias("x"), "y"))

    def _knots(self) -> DataFrame:
        """(m_g, x, y): the model's knots, and one at -inf for what is below a group's first."""
        k = self.model.select("m_g", "x", "y")
        return k.unionByName(k.groupBy("m_g").agg(F.min(F.struct("x", "y")).alias("k")).select("m_g", F.lit(float("-inf")).alias("x"), "k.y"))

    def _looked_up(self, r: DataFrame, n: int) -> DataFrame:
        """r with y__ between n knots, by search in all of them."""
        if not n:
            return r.withColumn("y__", F.lit(None).cast("double"))
        k = sorted((*row,) for row in self._knots().collect())
        groups, first, x0 = _sorted_list([(g, x) for g, x, _ in k])
        y0 = np.array([y for _, _, y in k])
        last = first[1:] - 1  # of each group
        x1, y1 = np.append(x0[1:], np.inf), np.append(y0[1:], np.nan)
        x1[last], y1[last] = np.inf, y0[last]

        @F.arrow_udf("double")
        def value(g: pa.Array, x: pa.Array) -> pa.Array:
            def of(g: pa.Array, x: np.ndarray) -> np.ndarray:
                i, least = places(groups, first, x0, g, x)
                return np.where(i >= least, between(x, x0[i], y0[i], x1[i], y1[i]), np.nan)

            return _where_valid(of, pa.float64(), g, x)

        return r.withColumn("y__", value("g__", "x__"))

    def _joined(self, r: DataFrame, n: int) -> DataFrame:
        """The same for more knots than one task should hold: by search in one of every few, and a join with those that lie between two of these."""
        few = -(-n * 2 // self.bound)
        k = running_sum(self._knots().withColumn("one__", F.lit(1)), ["m_g", "x"], "one__", "at__")
        k = stage(k.select("m_g", "x", "y", F.expr(f"at__ div {few}").alias("p"), (F.col("at__") % few == 0).alias("head")))
        groups, first, at = _sorted_list(sorted((*row,) for row in k.where("head").select("m_g", "x").collect()))

        @F.arrow_udf("long")
        def place(g: pa.Array, x: pa.Array) -> pa.Array:
            return _where_valid(lambda g, x: places(groups, first, at, g, x)[0], pa.int64(), g, x)

        @F.arrow_udf("double")
        def value(x: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
            return _where_valid(between, pa.float64(), x, x0, y0, x1, y1)

        # the head of the next list ends the last line of this one
        k = k.select("m_g", "x", "y", "p", F.lit(True).alias("own")).unionByName(k.where("head").select("m_g", "x", "y", (F.col("p") - 1).alias("p"), F.lit(False).alias("own")))
        by = Window.partitionBy("p", "m_g").orderBy("x")
        lines = k.select(F.col("m_g").alias("m_g__"), F.col("p").alias("p__"), F.col("x").alias("x0__"), F.col("y").alias("y0__"), F.coalesce(F.lead("x").over(by), F.lit(float("inf"))).alias("x1__"), F.coalesce(F.lead("y").over(by), F.col("y")).alias("y1__"), "own").where("own").drop("own")
        on = (F.col("g__") == F.col("m_g__")) & (F.col("at__") == F.col("p__")) & (F.col("x__") >= F.col("x0__")) & (F.col("x__") < F.col("x1__"))
        r = r.withColumn("at__", place("g__", "x__")).join(stage(lines), on, "left")
        return r.withColumn("y__", value("x__", "x0__", "y0__", "x1__", "y1__")).drop("at__", "m_g__", "p__", "x0__", "y0__", "x1__", "y1__")

    def transform(self, df: DataFrame, out: str = "score_cal") -> DataFrame:
        """df with the calibrated score as a double."""
        raw = without_nan(df, self.score).cast("double")
        r = df.withColumn("g__", without_nan(df, self.group).cast("string"))
        if self.method == "platt":
            m = broadcast_if_small(self.model.withColumnRenamed("m_g", "m_g__"), self.model.count())
            # clip skips NULL
            value = F.when(F.col("a").isNotNull() & raw.isNotNull(), sigmoid(clip(F.col("a") * raw + F.col("b"), -500.0, 500.0)))
            return r.join(m, same_keys(["g__"]), "left").withColumn(out, F.coalesce(value, raw)).drop("g__", "m_g__", "a", "b")
        r, n = r.withColumn("x__", finite(df, self.score)), self.model.count()
        y = self._looked_up(r, n) if n <= self.bound else self._joined(r, n)
        return y.withColumn(out, F.coalesce("y__", raw)).drop("g__", "x__", "y__")
