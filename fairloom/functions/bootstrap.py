"""Bootstrap intervals, drawn on executors.

A metric of binary predictions depends only on the counts of (group, label, prediction), so one aggregate feeds all draws: multinomial draws of these
counts are exactly the bootstrap of the rows, at a cost that does not depend on them. Groups lie in CHUNKS chunks by hash; a task draws a chunk's counts
and gives only the greatest and least rate of each draw, so nothing grows with groups times draws. When all rows are drawn together, the driver
draws how many fall in each chunk. Other values use a Poisson bootstrap: every row gets a Poisson(1) weight in each draw from a hash of its key
and the draw, the same wherever the row lies, and sums per group and draw are made before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, factorial, nan
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairloom.operators.grouping import finite, label
from fairloom.session import broadcast_if_small, stage

#: Chunks of groups that are drawn apart.
CHUNKS = 64
# The distribution function of Poisson(1) at 0 to 10.
POISSON = tuple(float(c) for c in np.cumsum([exp(-1) / factorial(k) for k in range(11)]))


def percentile_interval(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    d = np.asarray(draws, float)
    d = d[np.isfinite(d)]
    if not len(d):
        return nan, nan
    lo, hi = np.quantile(d, [(1 - level) / 2, (1 + level) / 2])
    return float(lo), float(hi)


def bca_interval(draws: np.ndarray, value: float, leave_one_out: np.ndarray, weights: np.ndarray | None = None, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated (Efron and Tibshirani 1993); leave_one_out may hold one value for each kind of row, weights how many there are."""
    d = np.asarray(draws, float)
    d = d[np.isfinite(d)]
    w = np.ones(len(leave_one_out)) if weights is None else np.asarray(weights, float)
    ok = np.isfinite(leave_one_out)
    j, w = np.asarray(leave_one_out, float)[ok], w[ok]
    if w.sum() < 5 or not len(d) or not np.isfinite(value):
        return percentile_interval(d, level)
    u = (w * j).sum() / w.sum() - j
    return _bca(d, value, (w * u**2).sum(), (w * u**3).sum(), w.sum(), level)


def _bca(draws: np.ndarray, value: float, a2: float, a3: float, n: float, level: float) -> tuple[float, float]:
    """a2, a3: sums of the squares and cubes of the leave-one-out values' distances from their mean."""
    d = np.asarray(draws, float)
    d = d[np.isfinite(d)]
    if n < 5 or not len(d) or not np.isfinite(value):
        return percentile_interval(d, level)
    a = a3 / (6 * a2**1.5) if a2 > 0 else 0.0
    norm = NormalDist()
    z0 = norm.inv_cdf(float(np.clip((d < value).mean() + 0.5 * (d == value).mean(), 1e-6, 1 - 1e-6)))
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + norm.inv_cdf(p)
        ends.append(float(np.clip(norm.cdf(z0 + z / (1 - a * z)), 0, 1)) if a * z != 1 else p)
    lo, hi = np.quantile(d, ends)
    return float(lo), float(hi)


def bootstrap_ci(data, stat_fn: Callable[[np.ndarray], float], *, B: int = 2000, level: float = 0.95, method: str = "percentile", random_state: int | None = 42) -> tuple[float, float]:
    """The interval of a statistic of a small local sample."""
    x = np.asarray(data)
    if not len(x):
        return nan, nan
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method!r}")
    rng = np.random.default_rng(random_state)
    draws = np.array([stat_fn(x[rng.integers(0, len(x), len(x))]) for _ in range(B)])
    if method == "percentile":
        return percentile_interval(draws, level)
    return bca_interval(draws, stat_fn(x), np.array([stat_fn(np.delete(x, i, axis=0)) for i in range(len(x))]), level=level)


def _rates(name: str, c: np.ndarray, least: int) -> np.ndarray:
    """(..., groups, 2): the rates whose gaps make the metric, NaN where there is none; c: (..., groups, label 0/1, prediction 0/1) counts."""
    c = c.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = c.sum((-1, -2))
        keep = n >= max(least, 1)
        none = np.full(n.shape, nan)
        if name == "demographic_parity_difference":
            return np.stack([np.where(keep, c[..., 1].sum(-1) / n, nan), none], -1)
        if name == "mae_parity_difference":
            return np.stack([np.where(keep, (c[..., 0, 1] + c[..., 1, 0]) / n, nan), none], -1)
        return np.stack([np.where(keep, c[..., y, 1] / c[..., y, :].sum(-1), nan) for y in (1, 0)], -1)


def _metric(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(..., 2) greatest and least rates of n groups -> the metric: the larger gap, NaN where no rate has two groups."""
    gaps = np.where(n >= 2, np.where(n >= 2, hi, 0) - np.where(n >= 2, lo, 0), nan)
    return np.fmax(gaps[..., 0], gaps[..., 1])


def _ends(rates: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ok = np.isfinite(rates)
    return np.where(ok, rates, -np.inf).max(axis), np.where(ok, rates, np.inf).min(axis), ok.sum(axis)


def _chunk_draws(counts: np.ndarray, name: str, least: int, draws: int, rng, total: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest and least rates and their number for each draw, over the groups of a chunk, some at a time; total: rows of each draw, None keeps group sizes."""
    hi, lo, n = np.full((draws, 2), -np.inf), np.full((draws, 2), np.inf), np.zeros((draws, 2), np.int64)
    left, rest = total, counts.sum()
    size = max(1, 2_000_000 // draws)
    for at in range(0, len(counts), size):
        part = counts[at : at + size]
        if total is None:
            d = np.stack([rng.multinomial(k.sum(), k / k.sum(), size=draws) for k in part], axis=1)
        else:  # how many of the rows left fall in this part, then where
            own = rng.binomial(left, min(1.0, part.sum() / rest))
            d = rng.multinomial(own, part.ravel() / part.sum()).reshape(draws, len(part), 4)
            left, rest = left - own, rest - part.sum()
        h, l, k = _ends(_rates(name, d.reshape(draws, len(part), 2, 2), least), 1)
        hi, lo, n = np.maximum(hi, h), np.minimum(lo, l), n + k
    return hi, lo, n


def _leave_one_out(name: str, counts: np.ndarray, least: int, tops: np.ndarray, bottoms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The metric without one row of each kind that groups hold, and how many such rows there are; tops, bottoms: (2, rates) the two greatest and least of all."""
    g, c = np.nonzero(counts)
    less = counts[g].copy()
    less[np.arange(len(g)), c] -= 1
    own, new = _rates(name, counts.reshape(-1, 2, 2), least)[g], _rates(name, less.reshape(-1, 2, 2), least)
    hi = np.fmax(np.where(own == tops[0], tops[1], tops[0]), np.where(np.isfinite(new), new, -np.inf))
    lo = np.fmin(np.where(own == bottoms[0], bottoms[1], bottoms[0]), np.where(np.isfinite(new), new, np.inf))
    return _metric(hi, lo, n - np.isfinite(own) + np.isfinite(new)), counts[g, c]


def interval_of_array(counts: np.ndarray, name: str, least: int, level: float = 0.95, method: str = "percentile", draws: int = 2000, seed: int = 42, stratified: bool = True) -> tuple[float, float]:
    """The same interval of a few groups' counts (groups, 2, 2) at hand, without a session."""
    flat = counts.reshape(-1, 4)
    flat = flat[flat.sum(1) > 0]
    if not len(flat):
        return nan, nan
    hi, lo, n = _chunk_draws(flat, name, least, draws, np.random.default_rng(seed), None if stratified else np.full(draws, flat.sum()))
    values = _metric(hi, lo, n)
    if method == "percentile":
        return percentile_interval(values, level)
    rates = np.sort(np.where(np.isfinite(r := _rates(name, flat.reshape(-1, 2, 2), least)), r, -np.inf), 0)[::-1]
    pad = np.full((2, 2), -np.inf)
    tops, bottoms = np.vstack([rates, pad])[:2], -np.vstack([np.sort(np.where(np.isfinite(r), -r, -np.inf), 0)[::-1], pad])[:2]
    k = np.isfinite(r).sum(0)
    v, w = _leave_one_out(name, flat, least, tops, bottoms, k)
    return bca_interval(values, float(_metric(tops[0], bottoms[0], k)), v, w, level)


def interval_of_counts(counts: DataFrame, name: str, least: int, level: float = 0.95, method: str = "percentile", draws: int = 2000, seed: int = 42, stratified: bool = True) -> tuple[float, float]:
    """From rows (grp, c00, c01, c10, c11), label first; stratified keeps the groups' sizes, else all rows are drawn together and small groups drop out anew in each
    draw. BCa takes one value for each kind of row that is left out."""
    if method not in ("percentile", "bca"):
        raise ValueError(f"unknown method {method!r}")
    cols = ["c00", "c01", "c10", "c11"]
    rows = stage(counts.where("c00 + c01 + c10 + c11 > 0").select(F.pmod(F.hash("grp"), F.lit(CHUNKS)).alias("chunk"), "grp", *cols))
    sums = dict(rows.groupBy("chunk").agg(F.sum(F.expr("c00 + c01 + c10 + c11"))).collect())  # at most CHUNKS
    if not sums:
        return nan, nan
    keys = sorted(sums)
    shares = None
    if not stratified:
        p = np.array([sums[k] for k in keys], float)
        shares = dict(zip(keys, np.random.default_rng([seed, CHUNKS]).multinomial(int(p.sum()), p / p.sum(), size=draws).T))

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("grp")
        k = int(p["chunk"].iloc[0])
        hi, lo, n = _chunk_draws(p[cols].to_numpy(np.int64), name, least, draws, np.random.default_rng([seed, k]), None if shares is None else shares[k])
        return pd.DataFrame({"b": np.repeat(np.arange(draws), 2), "m": np.tile([0, 1], draws), "hi": hi.ravel(), "lo": lo.ravel(), "n": n.ravel()})

    drawn = rows.groupBy("chunk").applyInPandas(draw, "b int, m int, hi double, lo double, n long")
    got = drawn.groupBy("b", "m").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("n").alias("n")).orderBy("b", "m").collect()  # two for each draw
    hi, lo, n = (np.array([r[c] for r in got], float).reshape(-1, 2) for c in ("hi", "lo", "n"))
    values = _metric(hi, lo, n)
    if method == "percentile":
        return percentile_interval(values, level)

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            r = _rates(name, p[cols].to_numpy(np.int64).reshape(-1, 2, 2), least)
            for m in (0, 1):
                x = np.sort(r[:, m][np.isfinite(r[:, m])])
                yield pd.DataFrame({"m": m, "n": len(x), "top": [x[::-1][:2].tolist()], "bottom": [x[:2].tolist()]})

    e = rows.mapInPandas(ends, "m int, n long, top array<double>, bottom array<double>").groupBy("m").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, 2).alias("top"), F.slice(F.array_sort(F.flatten(F.collect_list("bottom"))), 1, 2).alias("bottom"))
    e = {r["m"]: r for r in e.collect()}
    pad = lambda x, v: np.array([*x, v, v][:2])
    tops, bottoms = (np.stack([pad(e[m][k], v) for m in (0, 1)], 1) for k, v in (("top", -np.inf), ("bottom", np.inf)))
    n = np.array([e[m]["n"] for m in (0, 1)])
    value = float(_metric(tops[0], bottoms[0], n))

    def jack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v, w = _leave_one_out(name, p[cols].to_numpy(np.int64), least, tops, bottoms, n)
            yield pd.DataFrame({"v": v, "w": w.astype(float)})

    j = rows.mapInPandas(jack, "v double, w double").where("not isnan(v)").groupBy("v").agg(F.sum("w").alias("w"))
    mean = j.agg(F.sum(F.col("w") * F.col("v")) / F.sum("w"), F.sum("w")).first()
    if not mean[1]:
        return percentile_interval(values, level)
    u = F.lit(mean[0]) - F.col("v")
    a2, a3 = j.agg(F.sum(F.col("w") * u**2), F.sum(F.col("w") * u**3)).first()
    return _bca(values, value, a2, a3, mean[1], level)


def hashed_weight(key: Column, draw: Column) -> Column:
    """A Poisson(1) weight from the MD5 of 'key:draw', in built-in expressions and the same in every engine; up to 7."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key, draw)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum(((u >= c).cast("int") for c in POISSON[:7]), F.lit(0))


def hashed_sums(df: DataFrame, group: str, x: str, key: str, draws: int) -> DataFrame:
    """(grp, b, w, wx): sums of hashed weights, and of weights times x, per group and draw."""
    r = df.select(F.col(group).alias("grp"), F.col(x).alias("x"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    r = r.select("grp", "x", "b", hashed_weight(F.col("k"), F.col("b")).alias("w"))
    return r.groupBy("grp", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))


def gap_per_draw(sums: DataFrame) -> DataFrame:
    """(b, value): greatest less least mean of the groups in each draw."""
    r = sums.where("w > 0").select("b", (F.col("wx") / F.col("w")).alias("r"))
    return r.groupBy("b").agg(F.when(F.count("r") >= 2, F.max("r") - F.min("r")).alias("value"))


def poisson_sums(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(grp, b, w, wx): rows (grp, x, key), key a whole number, with Poisson(1) weights in each of draws resamples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, salt = np.array(POISSON), _mix(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        total: dict[str, np.ndarray] = {}
        for p in parts:
            keys, xs = p["key"].to_numpy(np.int64).view(np.uint64), p["x"].to_numpy()
            for g, idx in p.groupby("grp").indices.items():
                t = total.setdefault(g, np.zeros((draws, 2)))
                for at in range(0, len(idx), 512):
                    i = idx[at : at + 512]
                    u = (_mix(keys[i][None, :] ^ salt[:, None]) >> np.uint64(11)) * 2.0**-53
                    w = np.searchsorted(steps, u, side="right")
                    t[:, 0] += w.sum(1)
                    t[:, 1] += w @ xs[i]
            if len(total) * draws > 4_000_000:
                yield from _flushed(total, draws)
        yield from _flushed(total, draws)

    return rows.mapInPandas(run, "grp string, b int, w double, wx double").groupBy("grp", "b").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))


def _flushed(total: dict[str, np.ndarray], draws: int) -> Iterator[pd.DataFrame]:
    for g, t in total.items():
        yield pd.DataFrame({"grp": g, "b": np.arange(draws, dtype=np.int32), "w": t[:, 0], "wx": t[:, 1]})
    total.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def metric_interval(name: str, df: DataFrame, sensitive, y_pred: str, y_true: str | None, least: int, nan_policy: str, level: float, method: str, draws: int, seed: int, stratified: bool = True, key: list[str] | None = None) -> tuple[float, float]:
    """The interval of a metric of a table: from counts where predictions (and labels) are 0 or 1, else by Poisson weights (percentile only; BCa is an error there).

    key names the columns that tell rows apart for the weights, all of them if none are named; rows with equal keys are drawn together."""
    yt = finite(df, y_true) if y_true else F.lit(0.0)
    r = df.select(label(df, sensitive, nan_policy).alias("grp"), finite(df, y_pred).alias("yp"), yt.alias("yt"), F.xxhash64(*[F.col(f"`{c}`") for c in key or df.columns]).alias("key")).dropna()
    other = F.count(F.when(~F.col("yp").isin(0.0, 1.0) | ~F.col("yt").isin(0.0, 1.0), 1)).alias("other")
    cells = [F.count(F.when((F.col("yt") == y) & (F.col("yp") == p), 1)).alias(f"c{y}{p}") for y in (0, 1) for p in (0, 1)]
    g = stage(r.groupBy("grp").agg(F.count("*").alias("n"), other, *cells))
    kept = g.where(F.col("n") >= least)
    if not (kept if stratified else g).agg(F.sum("other")).first()[0]:
        return interval_of_counts(kept if stratified else g, name, least, level, method, draws, seed, stratified)
    if method != "percentile":
        raise ValueError("values other than 0 and 1 have percentile intervals only")
    if name == "equalized_odds_difference":
        parts = [(r.where(F.col("yt") == y), F.col("yp")) for y in (0, 1)]
    else:
        parts = [(r, F.abs(F.col("yt") - F.col("yp")) if name == "mae_parity_difference" else F.col("yp"))]
    big = broadcast_if_small(kept.select(F.col("grp").alias("k_grp")), kept.count())
    gaps = []
    for i, (rows, x) in enumerate(parts):
        rows = rows.join(big, F.col("grp") == F.col("k_grp")).select("grp", x.alias("x"), "key")
        got = dict(gap_per_draw(poisson_sums(rows, draws, seed + i)).collect())  # one for each draw
        gaps.append(np.array([nan if got.get(b) is None else got[b] for b in range(draws)], float))
    return percentile_interval(np.fmax.reduce(gaps), level)
