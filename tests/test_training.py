import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairloom.sources.files import benchmark_sample, dev_sample, read_table, train_sample, write_table
from fairloom.streaming.windows import gaps, windowed_group_sums
from fairloom.training import FairnessRegularizerLoss, GroupFairnessCalibrator, LagrangianFairnessTrainer, ReductionsWrapper, sweep_pareto
from fairloom.training.calibration import pool_adjacent


@pytest.fixture(scope="module")
def data(spark):
    return train_sample(spark, 400, 3).persist()


def test_violation_falls(data):
    t = LagrangianFairnessTrainer(hidden=[8], tol=0.02, rate=0.05, dual_rate=5.0).fit(data, ["f0", "f1", "f2"], epochs=25)
    assert set(t.history[0]) == {"epoch", "accuracy", "violation", "lambda"} and t.history[-1]["accuracy"] > 0.6
    lam = [h["lambda"] for h in t.history]
    assert lam == sorted(lam)
    free = LagrangianFairnessTrainer(hidden=[8], tol=9.0, rate=0.05).fit(data, ["f0", "f1", "f2"], epochs=25)
    gap = lambda m: abs(m.transform(data).groupBy("s").agg(F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("p")).agg(F.max("p") - F.min("p")).first()[0])
    assert gap(t) <= gap(free) + 0.02
    assert LagrangianFairnessTrainer(constraint="equal_opportunity").fit(data, ["f0"], epochs=2).history[-1]["epoch"] == 2
    with pytest.raises(ValueError):
        LagrangianFairnessTrainer(constraint="other")


def test_pareto(data):
    pts = sweep_pareto(data, ["f0", "f1", "f2"], etas=(0.0, 0.2), epochs=4, hidden=8)
    assert [p["eta"] for p in pts] == [0.0, 0.2] and all(0 <= p["accuracy"] <= 1 and 0 <= p["dp_diff"] <= 1 for p in pts)


def test_reductions(data):
    biased = data.withColumn("f1", F.col("s") * 2.0 + 0.1 * F.col("f1"))
    m = ReductionsWrapper(T=6, eps=0.02).fit(biased, ["f0", "f1"])
    out = m.predict_proba(biased)
    r = out.agg(F.min("probability_fair"), F.max("probability_fair"), F.count("*")).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] == 400
    with pytest.raises(RuntimeError):
        ReductionsWrapper().predict(biased)


def test_losses(spark):
    df = spark.createDataFrame([(0.5, 1, 0), (-1.0, 0, 1), (800.0, 1, 1), (-800.0, 0, 0)], "logit double, y int, s int")
    for mode in ("covariance", "mean_gap"):
        v = FairnessRegularizerLoss(0.3, mode)(df)
        assert np.isfinite(v) and v > 0
    with pytest.raises(ValueError):
        FairnessRegularizerLoss(mode="x")


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration(spark, method):
    rng = np.random.default_rng(0)
    rows = []
    for g, shift in (("a", 0.2), ("b", -0.2)):
        for s in rng.random(300):
            rows.append((float(s), int(rng.random() < np.clip(s + shift, 0, 1)), g))
    rows += [(0.3, 1, "few")] * 3 + [(0.4, 1, None), (None, 1, "a"), (float("nan"), 0, "a")] + [(0.5, 1, "one")] * 30
    df = spark.createDataFrame(rows, "score double, y int, g string")
    out = GroupFairnessCalibrator(method).fit(df).transform(df)
    assert out.count() == len(rows)
    r = {x["g"]: x for x in out.where("score is not null and not isnan(score)").groupBy("g").agg(F.avg("score_cal").alias("p"), F.avg("y").alias("y"), F.min("score_cal").alias("lo"), F.max("score_cal").alias("hi")).collect()}
    for g in "ab":
        assert r[g]["p"] == pytest.approx(r[g]["y"], abs=0.03) and 0 <= r[g]["lo"] <= r[g]["hi"] <= 1
    assert r["few"]["p"] == pytest.approx(0.3) and r[None]["p"] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        GroupFairnessCalibrator("other")


def test_pooling_in_parts_is_pooling_at_once():
    rng = np.random.default_rng(2)
    x, y = np.arange(200.0), rng.random(200) + np.arange(200) / 100
    once = pool_adjacent(x, x, np.ones(200), y)
    parts = [b for i in range(0, 200, 37) for b in pool_adjacent(x[i : i + 37], x[i : i + 37], np.ones(len(x[i : i + 37])), y[i : i + 37])]
    again = pool_adjacent(*map(np.array, zip(*parts)))
    assert np.allclose(once, again)


def test_windows(spark):
    rows = [(f"2024-01-01 0{h}:10:00", g, p) for h in (1, 2) for g, ps in (("a", (1, 1)), ("b", (0, h - 1))) for p in ps]
    df = spark.createDataFrame(rows, "t string, g string, p int").withColumn("t", F.col("t").cast("timestamp"))
    got = [r["dpd"] for r in gaps(windowed_group_sums(df, "t", "g", "p"), 1).orderBy("window_start").collect()]
    assert got == [1.0, 0.5]


def test_sources(spark, tmp_path):
    for kind in ("csv", "json", "orc", "parquet"):
        p = str(tmp_path / f"x.{kind}")
        write_table(dev_sample(spark, 50), p)
        assert read_table(spark, p).count() == 50
    assert benchmark_sample(spark, 100).columns == ["race", "gender", "age_group", "y_true", "y_pred", "y_reg", "y_hat"]


def test_batches_orders_and_rows_that_teach_nothing(spark, data):
    t = LagrangianFairnessTrainer(hidden=[8], rate=0.02, batch_size=100).fit(data, ["f0", "f1"], epochs=2)
    assert len(t.history) == 2 and t.history[-1]["accuracy"] > 0.5
    dirty = data.select("f0", "f1", "y", "s").unionByName(spark.createDataFrame([(None, 1.0, 1, 0), (float("inf"), 1.0, 1, 0), (float("nan"), 0.0, 0, 1), (0.1, 0.1, None, 0), (0.1, 0.1, 7, 1), (0.1, 0.1, 1, None)], "f0 double, f1 double, y int, s int"))
    clean = LagrangianFairnessTrainer(hidden=[4]).fit(data, ["f0", "f1"], epochs=2)
    assert np.allclose([h["accuracy"] for h in LagrangianFairnessTrainer(hidden=[4]).fit(dirty, ["f0", "f1"], epochs=2).history], [h["accuracy"] for h in clean.history])
    ranked = spark.createDataFrame([(float(i), int(i >= 80), i % 2, i) for i in range(100)], "f0 double, y int, s int, at int")
    pts = sweep_pareto(ranked, ["f0"], etas=(0.0,), epochs=1, hidden=2, order="at")  # trained on the first 80, all of label 0
    assert len(pts) == 1
    m = ReductionsWrapper(T=2).fit(dirty, ["f0", "f1"])
    assert m.predict_proba(dirty).where("probability_fair is null").count() == 3


def test_isotonic_in_parts_is_isotonic_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(float(np.round(rng.beta(2, 3), 2)) if g == "tied" else float(x), int(rng.random() < x), g) for g in ("tied", "free") for x in rng.random(400)]
    df = spark.createDataFrame(rows, "score double, y int, g string")
    out = []
    for part in (7, 100_000):
        c = GroupFairnessCalibrator("isotonic", part=part).fit(df)
        out.append(sorted((r["g"], r["score"], round(r["score_cal"], 9)) for r in c.transform(df.unionByName(spark.createDataFrame([(-1.0, 0, "free"), (9.0, 1, "free")], df.schema))).collect()))
    assert out[0] == out[1]
    for g in ("tied", "free"):
        y = [p for h, _, p in out[0] if h == g]
        assert y == sorted(y)


def test_isotonic_of_a_hot_group_takes_no_time_for_pairs_of_scores(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") / n).alias("score"), (F.rand(5) < F.col("id") / n).cast("int").alias("y"), F.lit("hot").alias("g")).persist()
    began = time.monotonic()
    got = GroupFairnessCalibrator("isotonic").fit(df).transform(df).toPandas().sort_values("score")
    assert time.monotonic() - began < 45
    x, y = got["score"].to_numpy(), got["y"].to_numpy(dtype=float)
    want = np.concatenate([np.full(int(w), m) for _, _, w, m in pool_adjacent(x, x, np.ones(n), y)])
    assert np.allclose(got["score_cal"], want, atol=1e-9)


def test_isotonic_scores_are_the_same_by_search_and_by_join(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), int(rng.random() < x), g) for g in ("a", "b", "\u00e9", "c") for x in rng.random(150)] + [(-1e308, 0, "far"), (1e308, 1, "far")] * 10 + [(-0.0, 0, "zero"), (0.0, 1, "zero"), (5e-324, 1, "zero")] * 10
    asked = [(float(x), 0, g) for g in ("", "a", "b", "bb", "\u00e9", "zz", "far", "zero", None) for x in (-2.0, -0.0, 0.0, 5e-324, 0.3, 0.6, 2.0, 1e308, -1e308)] + [(None, 0, "a"), (float("nan"), 0, "a"), (float("inf"), 0, "a")]
    schema = "score double, y int, g string"
    df, ask = spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)
    out = []
    for bound in (200_000, 40, 7):
        r = GroupFairnessCalibrator("isotonic", bound=bound).fit(df).transform(ask)
        assert r.columns == ["score", "y", "g", "score_cal"]
        out.append(sorted(repr((x["g"], x["score"], None if x["score_cal"] is None else round(x["score_cal"], 9))) for x in r.collect()))
    assert out[0] == out[1] == out[2] and len(out[0]) == len(asked)
    r = {(g, x): y for g, x, y in (eval(s, {"nan": None, "inf": float("inf")}) for s in out[0])}
    for g in ("a", "b", "\u00e9"):
        k = sorted((x, y) for x, y, h in rows if h == g)
        x, y = np.array(k).T
        b = pool_adjacent(x, x, np.ones(len(x)), y)
        knots = np.array([(e, m) for lo, hi, _, m in b for e in (lo, hi)])
        for v in (-2.0, 0.3, 0.6, 2.0):
            assert r[g, v] == pytest.approx(np.interp(v, *knots.T), abs=1e-8)
    assert r["far", 0.3] == pytest.approx(0.5) and r["far", 2.0] == pytest.approx(0.5) and r["far", 1e308] == 1 and r["far", -1e308] == 0
    assert r["zero", 0.0] == 0.5 and r["zero", 5e-324] == 1 and r["zero", -2.0] == 0.5
    assert r["bb", 0.3] == 0.3 and r[None, 0.6] == 0.6 and r["a", None] is None and r["a", float("inf")] == float("inf")
    none = GroupFairnessCalibrator("isotonic", min_samples=10_000).fit(df).transform(df)
    assert none.where("score_cal = score").count() == len(rows)


def test_models_survive_their_session(spark, data, tmp_path):
    from fairloom.operators.mitigation import DisparateImpactRemover, ProxyDropper, ReweighingTransformer
    from fairloom.pipeline.models import load, save

    df = spark.createDataFrame([(i % 3 / 2, i % 2, "ab"[i % 2], float(i % 17)) for i in range(200)], "score double, y int, g string, x double")
    fitted = [ReweighingTransformer(["g"]).fit(df), DisparateImpactRemover("g", ["x"]).fit(df), ProxyDropper(["g"], ["x", "y"]).fit(df), GroupFairnessCalibrator("isotonic").fit(df), GroupFairnessCalibrator("platt").fit(df)]
    fitted.append(LagrangianFairnessTrainer(hidden=[3]).fit(data, ["f0", "f1"], epochs=1))
    for i, m in enumerate(fitted):
        save(m, str(tmp_path / f"m{i}"), spark)
        src = data.select("f0", "f1", "y") if i == 5 else df
        a, b = (sorted(str(r) for r in x.transform(src).collect()) for x in (m, load(str(tmp_path / f"m{i}"), spark)))
        assert a == b
    with pytest.raises(ValueError):
        save(3, str(tmp_path / "no"), spark)


def test_normal_columns(spark):
    from fairloom.functions.special import normal_cdf, normal_quantile

    r = spark.createDataFrame([(0.0, 0.975), (1.96, 0.0), (None, 2.0)], "x double, p double").select(normal_cdf(F.col("x")), normal_quantile(F.col("p"))).collect()
    assert r[0][0] == 0.5 and r[0][1] == pytest.approx(1.959964) and r[1][0] == pytest.approx(0.9750021) and r[1][1] == -np.inf and r[2][0] is None and r[2][1] is None
