import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairloom import DisparateImpactRemover, InstanceReweighting, ProxyDropper, ReweighingTransformer, run_detectors
from fairloom.cli import main
from fairloom.functions.scalar import benjamini_hochberg, bonferroni
from fairloom.pipeline.config import apply_pipeline, build_pipeline, load_config


def test_detectors_on_benign_and_tiny_tables(spark):
    rng = np.random.default_rng(42)
    rows = [("AB"[i % 2], float(rng.normal()), float(rng.normal()), i // 2 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, f1 double, f2 double, y int")
    s = run_detectors(df, ["g"], {"g": {"A": 0.5, "B": 0.5}}, 0.01, 0.6).to_dict()["body"]["summary"]
    assert (s["representation_flags"], s["disparity_flags"], s["proxy_flags"]) == (0, 0, 0)
    two = spark.createDataFrame([("A", 0.1, 1, None), ("B", 0.2, 0, None)], "g string, f1 double, f2 int, y string")
    r = run_detectors(two, ["g"]).to_dict()
    assert r["meta"]["phase"] == "0" and all(x["pvalue"] is None or 0 <= x["pvalue"] <= 1 for x in r["body"]["disparities"])
    empty = run_detectors(two.limit(0), ["g"], {"g": {"A": 1.0}}).to_dict()
    assert empty["body"]["disparities"] == []


def test_detectors_find_a_proxy(spark):
    rows = [("AB"[i % 2], "pq"[i % 2], i % 2 * 10.0 + i % 5) for i in range(300)]
    r = run_detectors(spark.createDataFrame(rows, "g string, copy string, x double"), ["g"], {"g": {"A": 0.9, "B": 0.1}}).to_dict()["body"]
    assert r["summary"] == {"sensitive": ["g"], "alpha": 0.05, "proxy_threshold": 0.3, "representation_flags": 1, "disparity_flags": 2, "proxy_flags": 2}
    assert {x["feature"]: x["measure"] for x in r["proxies"]} == {"copy": "cramers_v", "x": "eta_squared"}


def test_weights_average_one(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "x")] * 2 + [(None, "y")] * 2, "g string, h string")
    for t in (InstanceReweighting(["g", "h", "missing"]), ReweighingTransformer(["g", "h"]), InstanceReweighting(["g"], {"g": {"a": 0.5, "b": 0.5}})):
        out = t.fit(df).transform(df)
        assert out.count() == 10 and out.agg(F.avg("sample_weight")).first()[0] == pytest.approx(1)
    w = {r["g"]: r["sample_weight"] for r in InstanceReweighting(["g"]).fit(df).transform(df).collect()}
    assert w["a"] < w[None] < w["b"]
    with pytest.raises(ValueError):
        ReweighingTransformer(["nope"]).fit(df)
    none = df.limit(0)
    assert ReweighingTransformer(["g"]).fit(none).transform(none).count() == 0


def test_repair(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(np.round(rng.normal(i % 2 * 2, 1), 1))) for i in range(400)] + [(1000, None, 9.0), (1001, "tiny", 7.0), (1002, "a", None)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    same = {r["id"]: r["x"] for r in DisparateImpactRemover("g", ["x"], 0.0).fit(df).transform(df).collect()}
    assert same == {r[0]: r[2] for r in rows}
    full = DisparateImpactRemover("g", ["x"]).fit(df).transform(df)
    got = {r["id"]: r["x"] for r in full.collect()}
    assert got[1000] == 9.0 and got[1001] == 7.0 and got[1002] is None and len(got) == len(rows)
    q = {r["g"]: r["q"] for r in full.where("g in ('a', 'b')").groupBy("g").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).collect()}
    assert np.allclose(q["a"], q["b"], atol=0.15)
    order = {i: (g, x) for i, g, x in rows}
    a = sorted((i for i in got if order[i][0] == "a" and order[i][1] is not None), key=lambda i: order[i][1])
    assert all(got[i] <= got[j] + 1e-9 for i, j in zip(a, a[1:]))


def test_proxies_are_dropped_strongest_first(spark):
    rows = [("AB"[i % 2], "pq"[i % 2], float(i % 2) + i % 3, float(i % 7), "k") for i in range(120)]
    df = spark.createDataFrame(rows, "g string, copy string, near double, far double, same string")
    m = ProxyDropper(["g"], threshold=0.3).fit(df)
    assert m.dropped == ["copy", "near"] and m.scores["same"] == 0.0
    assert ProxyDropper(["g"], max_drop=1).fit(df).transform(df).columns == ["g", "near", "far", "same"]


def test_multiple_tests(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    r = {x["k"]: x for x in benjamini_hochberg(bonferroni(df, "p"), "p", ["k"]).collect()}
    assert r["a"]["p_bonferroni"] == pytest.approx(0.03) and r["d"]["p_bh"] is None
    assert [round(r[k]["p_bh"], 6) for k in "abc"] == [0.03, 0.04, 0.04]


CONFIG = """
sensitive: [group]
benchmarks: {group: {A: 0.5, B: 0.5}}
alpha: 0.05
profiles:
  pipeline:
    pipeline:
      - {name: weigh, transformer: InstanceReweighting}
      - {name: repair, transformer: DisparateImpactRemover, params: {features: [x1], repair_level: 0.8, min_group_size: 2}}
  other:
    steps: [{kind: disparate_impact, params: {features: [x1]}}]
"""


def test_config_and_command_line(spark, tmp_path):
    cfg = load_config(text=CONFIG)
    assert cfg.sensitive == ["group"] and [s.transformer for s in cfg.pipeline] == ["InstanceReweighting", "DisparateImpactRemover"]
    assert load_config(text=CONFIG, profile="other").pipeline[0].transformer == "DisparateImpactRemover"
    for bad in ({"text": CONFIG, "profile": "none"}, {"text": CONFIG, "path": "x"}, {}):
        with pytest.raises(ValueError):
            load_config(**bad)
    with pytest.raises(ValueError):
        build_pipeline(load_config(obj={"sensitive": "g"}))
    df = spark.createDataFrame([("A", 1.0, 1, 0), ("A", 2.0, 0, 1), ("B", 3.0, 1, 1), ("B", 5.0, 0, 0), ("A", 4.0, 1, 1)], "group string, x1 double, x2 int, y int")
    out = apply_pipeline(cfg, df)
    assert "sample_weight" in out.columns and out.count() == 5
    csv, conf = str(tmp_path / "in.csv"), tmp_path / "c.yml"
    df.toPandas().to_csv(csv, index=False)
    conf.write_text(CONFIG)
    assert main(["pipeline", "--config", str(conf), "--csv", csv, "--out", str(tmp_path / "out.csv"), "--detector-json", str(tmp_path / "d.json"), "--report-md", str(tmp_path / "r.md")]) == 0
    d = json.loads((tmp_path / "d.json").read_text())
    assert set(d) == {"meta", "body"} and {"summary", "representation", "disparities", "proxies"} <= set(d["body"])
    assert main(["validate", "--csv", csv, "--y-true", "y", "--y-pred", "x2", "--sensitive", "group", "--min-group-size", "1", "--with-ci", "--bootstrap-b", "20", "--out", str(tmp_path / "v.md")]) == 0
    assert "equalized_odds_difference" in (tmp_path / "v.md").read_text()
    assert main(["check", "--csv", csv, "--y-true", "y", "--y-pred", "x2", "--sensitive", "group", "--min-group-size", "1", "--threshold", "0.9"]) in (0, 2)
    assert main(["check", "--csv", csv, "--sensitive", "nope"]) == 2
    assert main(["version"]) == 0
    assert main(["check", "--csv", csv, "--y-true", "y", "--score", "x1", "--sensitive", "group", "--min-group-size", "1", "--threshold", "9", "--json", str(tmp_path / "q.json"), "--md", str(tmp_path / "q.md")]) == 0
    assert json.loads((tmp_path / "q.json").read_text()) and "demographic" in (tmp_path / "q.md").read_text()
    assert main(["pipeline", "--config", str(conf), "--csv", csv, "--out-csv", str(tmp_path / "o2.csv"), "--no-detectors", "--report-md", str(tmp_path / "r2.md")]) == 0
    assert main(["sample-check", csv]) == 0 and main(["sample-check", str(tmp_path / "none.csv")]) == 2
    flat = str(tmp_path / "t.csv")
    spark.range(60).selectExpr("id % 7 / 7.0 f0", "id % 5 / 5.0 f1", "cast(id % 2 as int) y", "cast(id % 3 = 0 as int) s").toPandas().to_csv(flat, index=False)
    assert main(["train-lagrangian", "--csv", flat, "--fairness", "equal_opportunity", "--eo-tol", "0.1", "--model-lr", "0.01", "--lambda-lr", "0.1", "--epochs", "1", "--batch-size", "30", "--out-json", str(tmp_path / "h.json")]) == 0
    assert main(["train-regularized", "--csv", flat, "--etas", "0.0,0.5", "--epochs", "1", "--lr", "0.01", "--out-json", str(tmp_path / "p.json")]) == 0
    assert [p["eta"] for p in json.loads((tmp_path / "p.json").read_text())] == [0.0, 0.5]
