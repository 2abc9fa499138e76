import numpy as np
from pyspark.sql import functions as F
import pytest

from fairloom import FairnessAnalyzer, assert_fairness, bootstrap_ci, to_markdown_report
from fairloom.functions.bootstrap import bca_interval, interval_of_array, interval_of_counts, metric_interval, poisson_sums
from fairloom.operators.metrics import eod, group_stats, rates_by_subset


def test_small_groups_drop_out(spark):
    df = spark.createDataFrame([(1, "A")] * 3 + [(0, "A"), (1, "B"), (0, "B"), (0, "B"), (1, "C")], "y_pred int, sensitive string")
    an = FairnessAnalyzer(min_group_size=3)
    r = an.collect(an.demographic_parity_difference(df, y_pred="y_pred", sensitive="sensitive", with_effect_size=True))
    assert r.n_per_group == {"A": 4, "B": 3}
    assert r.value == pytest.approx(0.75 - 1 / 3) and r.effect_size == pytest.approx(2.25) and r.ci is None


def test_no_negatives(spark):
    df = spark.createDataFrame([(1, 1, "X"), (1, 1, "X"), (1, 1, "Y"), (1, 0, "Y"), (1, 1, "Y"), (1, 0, "Y")], "t int, p int, g string")
    s = group_stats(df, "g", "p", "t", 1)
    assert eod(s).first()["value"] == pytest.approx(0.5)
    assert eod(s, "strict").first()["value"] is None


def test_missing_attributes(spark):
    df = spark.createDataFrame([(1, "A", "F"), (0, "A", "F"), (1, None, "F"), (1, "B", None), (0, "B", "M")], "p int, race string, sex string")
    an = FairnessAnalyzer(2, "include")
    r = an.collect(an.demographic_parity_difference(df, y_pred="p", sensitive=["race", "sex"]))
    assert r.value is None and r.n_per_group == {"A||F": 2}
    r = FairnessAnalyzer(1).demographic_parity_difference(df, y_pred="p", sensitive="race, sex")
    assert set(FairnessAnalyzer.collect(r).n_per_group) == {"A||F", "B||M"}


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "p int, t int, g string")
    an = FairnessAnalyzer(1)
    for r in (an.demographic_parity_difference(empty, y_pred="p", sensitive="g", with_ci=True, draws=10), an.equalized_odds_difference(empty, y_true="t", y_pred="p", sensitive="g"), an.mae_parity_difference(empty, y_true="t", y_pred="p", sensitive="g", with_effect_size=True)):
        x = an.collect(r)
        assert x.value is None and x.n_per_group == {} and x.effect_size is None
    one = spark.createDataFrame([(1, 5), (0, 5)], "p int, g int")
    assert an.collect(an.demographic_parity_difference(one, y_pred="p", sensitive="g")).n_per_group == {"5": 2}
    with pytest.raises(ValueError):
        an.demographic_parity_difference(one, y_pred="nope", sensitive="g")
    with pytest.raises(RuntimeError):
        FairnessAnalyzer(backend="other")


def test_mae_effect_takes_the_first_of_tied_groups(spark):
    rows = [(0.0, e, g) for g in "ab" for e in (1.0, 3.0)] + [(0.0, e, "c") for e in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, p double, g string")
    an = FairnessAnalyzer(1)
    r = an.collect(an.mae_parity_difference(df, y_true="t", y_pred="p", sensitive="g", with_effect_size=True))
    assert r.value == pytest.approx(1.5) and r.effect_size == pytest.approx(1.5 / np.sqrt((2 + 0.5) / 2))


def test_subsets(spark):
    df = spark.createDataFrame([(1, "a", "x"), (0, "a", "y"), (1, "b", "x"), (1, "b", "y")], "p int, u string, v string")
    got = {r["attributes"]: r["value"] for r in rates_by_subset(df, ["u", "v"], "p", 1).collect()}
    assert got == {"u": 0.5, "v": 0.5, "u||v": 1.0}


@pytest.mark.parametrize("method", ["percentile", "bca"])
def test_intervals_cover(method):
    rng, hit = np.random.default_rng(5), 0
    for _ in range(150):
        a, b = rng.binomial(400, 0.6), rng.binomial(400, 0.5)
        counts = np.array([[[400 - a, a], [0, 0]], [[400 - b, b], [0, 0]]])
        lo, hi = interval_of_array(counts, "demographic_parity_difference", 30, 0.9, method, 300, int(rng.integers(1e9)))
        hit += lo <= 0.1 <= hi
    assert 0.82 <= hit / 150 <= 0.97


def test_generic_bootstrap():
    x = np.random.default_rng(1).normal(5, 1, 100)
    for m in ("percentile", "bca"):
        lo, hi = bootstrap_ci(x, np.mean, B=400, method=m)
        assert lo < x.mean() < hi and hi - lo < 0.6
    assert np.isnan(bootstrap_ci([], np.mean)).all()
    with pytest.raises(ValueError):
        bootstrap_ci(x, np.mean, method="other")
    assert bca_interval(np.arange(10.0), 5.0, np.array([1.0, 2.0]))[0] <= 5


def test_interval_of_scores_uses_weights(spark):
    rng = np.random.default_rng(0)
    rows = [(float(v), "a") for v in rng.random(400)] + [(float(v) * 0.5, "b") for v in rng.random(400)]
    an = FairnessAnalyzer()
    r = an.collect(an.demographic_parity_difference(spark.createDataFrame(rows, "p double, g string"), y_pred="p", sensitive="g", with_ci=True, draws=200))
    assert r.ci[0] < r.value < r.ci[1] and r.ci[1] - r.ci[0] < 0.15


def test_reports_and_gates(spark):
    df = spark.createDataFrame([(1, "A"), (0, "A"), (1, "B")], "p int, g string")
    an = FairnessAnalyzer(1)
    text = to_markdown_report([an.collect(an.demographic_parity_difference(df, y_pred="p", sensitive="g"))])
    assert "| demographic_parity_difference | 0.500000 | — | — | A: 2, B: 1 |" in text
    assert_fairness(0.05, 0.1)
    assert_fairness(0.2, 0.1, comparator=">=")
    assert_fairness(float("nan"), 0.1, allow_nan=True)
    for bad in ((0.2, 0.1, "<="), (0.05, 0.1, ">"), (float("nan"), 0.1, "<=")):
        with pytest.raises(AssertionError):
            assert_fairness(bad[0], bad[1], comparator=bad[2])


def _by_hand(c, name, least):
    """The metric of counts (groups, 4), one loop a group."""
    gaps = []
    for y in (0, 1):
        r = []
        for c00, c01, c10, c11 in c.tolist():
            n = c00 + c01 + c10 + c11
            pos, all_ = {"demographic_parity_difference": (c01 + c11, n), "mae_parity_difference": (c01 + c10, n)}.get(name, ((c01, c00 + c01), (c11, c10 + c11))[y])
            if n >= max(least, 1) and all_:
                r.append(pos / all_)
        if len(r) >= 2:
            gaps.append(max(r) - min(r))
    return max(gaps) if gaps else np.nan


@pytest.mark.parametrize("name", ["demographic_parity_difference", "equalized_odds_difference", "mae_parity_difference"])
def test_leaving_one_row_out_by_hand(name):
    from fairloom.functions import bootstrap as b

    rng = np.random.default_rng(1)
    for least in (1, 6):
        c = rng.integers(0, 5, (6, 4))
        c = np.vstack([c, c[:2], [[3, 0, 0, 3]]])
        c = c[c.sum(1) > 0]
        r = b._rates(name, c.reshape(-1, 2, 2), least)
        tops = np.sort(np.where(np.isfinite(r), r, -np.inf), 0)[::-1][:2]
        bottoms = np.sort(np.where(np.isfinite(r), r, np.inf), 0)[:2]
        v, w = b._leave_one_out(name, c, least, tops, bottoms, np.isfinite(r).sum(0))
        want = []
        for g, k in zip(*np.nonzero(c)):
            less = c.copy()
            less[g, k] -= 1
            want.append(_by_hand(less, name, least))
        assert np.allclose(v, want, equal_nan=True) and w.sum() == c.sum()


def test_intervals_on_executors(spark, monkeypatch):
    from fairloom.functions import bootstrap as b

    rng = np.random.default_rng(3)
    c = rng.integers(20, 200, (40, 4))
    df = spark.createDataFrame([(f"g{i}", *map(int, x)) for i, x in enumerate(c)], "grp string, c00 long, c01 long, c10 long, c11 long")
    for method in ("percentile", "bca"):
        for strat in (True, False):
            x = interval_of_counts(df, "equalized_odds_difference", 30, 0.9, method, 800, 1, strat)
            y = interval_of_array(c.reshape(-1, 2, 2), "equalized_odds_difference", 30, 0.9, method, 800, 2, strat)
            assert np.allclose(x, y, atol=0.03) and x == interval_of_counts(df.repartition(5), "equalized_odds_difference", 30, 0.9, method, 800, 1, strat)
    assert np.isnan(interval_of_counts(df.limit(0), "demographic_parity_difference", 1)).all()


def test_poisson_weights_do_not_depend_on_the_place(spark):
    rows = [("a" if i % 3 else "b", float(i % 7), i) for i in range(500)] + [("a", 1.0, 1)] * 2
    df = spark.createDataFrame(rows, "grp string, x double, key long")
    got = [sorted(tuple(r) for r in poisson_sums(df.repartition(n), 50, 4).collect()) for n in (1, 7)]
    assert got[0] == got[1] and abs(np.mean([r[2] for r in got[0] if r[0] == "b"]) - 167) < 10
    other = df.withColumns({"y": F.lit(0.5), "k2": F.col("key")})
    with pytest.raises(ValueError):
        metric_interval("mae_parity_difference", other, "grp", "x", "y", 1, "exclude", 0.9, "bca", 50, 1)
    lo, hi = metric_interval("mae_parity_difference", other, "grp", "x", "y", 1, "exclude", 0.9, "percentile", 50, 1, key=["key"])
    assert 0 <= lo <= hi < 2
