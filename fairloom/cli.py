"""Command line: version, validate, check, sample-check, pipeline, train-regularized, train-lagrangian, train-reduced, calibrate."""

from __future__ import annotations

import argparse
import json
import sys

from fairloom import __version__
from fairloom.integration.report import pipeline_markdown, to_json_report, to_markdown_report
from fairloom.operators.grouping import columns_of, require
from fairloom.operators.metrics import FairnessAnalyzer, MetricResult
from fairloom.session import get_spark, ship
from fairloom.sources.files import read_table, write_table, write_text


def _spark():
    spark = get_spark("fairloom-cli")
    ship(spark)
    return spark


def _analyse(df, a) -> list[MetricResult]:
    groups = columns_of(a.sensitive)
    if bool(a.y_pred) == bool(a.score):
        raise ValueError("give exactly one of --y-pred and --score")
    pred = a.y_pred or a.score
    require(df, [*groups, pred, *([a.y_true] if a.y_true else [])])
    an = FairnessAnalyzer(a.min_group_size, a.nan_policy, a.backend)
    opts = {"with_ci": a.with_ci, "ci_level": a.ci_level, "ci_method": a.ci_method, "with_effect_size": a.with_effects, "draws": a.bootstrap_b}
    out = [an.demographic_parity_difference(df, y_pred=pred, sensitive=groups, **opts)]
    if a.y_true and a.y_pred:
        out.append(an.equalized_odds_difference(df, y_true=a.y_true, y_pred=pred, sensitive=groups, **opts))
    if a.y_true:
        out.append(an.mae_parity_difference(df, y_true=a.y_true, y_pred=pred, sensitive=groups, **opts))
    return [an.collect(r) for r in out]


def validate(a) -> int:
    results = _analyse(read_table(_spark(), a.csv), a)
    text = to_markdown_report(results, a.title, a.ci_level)
    if a.out:
        write_text(a.out, text)
    if a.json:
        write_text(a.json, to_json_report(results))
    print(text)
    return 0


def check(a) -> int:
    """0 if all metrics are within the threshold or missing, 2 if one is not or a column is missing."""
    if not (a.y_pred or a.score):
        a.y_pred = "y_pred"
    try:
        results = _analyse(read_table(_spark(), a.csv), a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if a.json:
        write_text(a.json, to_json_report(results))
    failed = [r.metric for r in results if r.value is not None and r.value > a.threshold]
    missing = [r.metric for r in results if r.value is None]
    if a.out:
        write_text(a.out, json.dumps({"threshold": a.threshold, "failed": failed, "missing": missing, "values": {r.metric: r.value for r in results}}, indent=2))
    if a.md:
        write_text(a.md, to_markdown_report(results))
    print(to_markdown_report(results), "FAIL " + ", ".join(failed) if failed else "WARN " + ", ".join(missing) if missing else "PASS")
    return 2 if failed else 0


def sample_check(a) -> int:
    """0 if the file is there and can be read as a table with rows, 2 if not."""
    try:
        n = len(read_table(_spark(), a.csv).limit(1).collect())
    except Exception as e:  # Spark tells a missing or broken file in many ways
        print(str(e).split("\n")[0], file=sys.stderr)
        return 2
    print("ok" if n else "empty")
    return 0 if n else 2


def pipeline(a) -> int:
    from fairloom.pipeline.config import apply_pipeline, detect, load_config

    cfg = load_config(a.config, profile=a.profile)
    df = read_table(_spark(), a.csv)
    found = {}
    if not a.no_detectors:
        report = detect(cfg, df)
        if a.detector_json:
            report.to_json(a.detector_json)
        found = report.to_dict() if a.report_md else {}
    out = apply_pipeline(cfg, df) if cfg.pipeline else df
    if a.out:
        write_table(out, a.out)
    if a.report_md:
        write_text(a.report_md, pipeline_markdown(a.config, a.csv, a.out or "-", found))
    return 0


def train_lagrangian(a) -> int:
    from fairloom.training import LagrangianFairnessTrainer
    from fairloom.training.trainers import feature_columns

    df = read_table(_spark(), a.csv)
    tol = a.tol if a.tol is not None else a.dp_tol if a.constraint == "demographic_parity" else a.eo_tol
    t = LagrangianFairnessTrainer(constraint=a.constraint, tol=tol, rate=a.model_lr, dual_rate=a.lambda_lr, batch_size=a.batch_size or None).fit(df, feature_columns(df), epochs=a.epochs)
    write_text(a.out, t.history_json())
    return 0


def train_regularized(a) -> int:
    from fairloom.training import plot_pareto, sweep_pareto
    from fairloom.training.trainers import feature_columns

    df = read_table(_spark(), a.csv)
    points = sweep_pareto(df, feature_columns(df), etas=tuple(float(x) for x in columns_of(a.etas)), epochs=a.epochs, rate=a.lr, order=a.order)
    write_text(a.out, json.dumps(points, indent=2))
    if a.png:
        plot_pareto(points, a.png)
    return 0


def train_reduced(a) -> int:
    from fairloom.training import ReductionsWrapper
    from fairloom.training.trainers import feature_columns

    df = read_table(_spark(), a.csv)
    m = ReductionsWrapper(a.constraint, a.eps, a.rounds).fit(df, feature_columns(df))
    write_table(m.predict_proba(df), a.out)
    return 0


def calibrate(a) -> int:
    from pyspark.sql import functions as F

    from fairloom.training import GroupFairnessCalibrator

    df = read_table(_spark(), a.csv)
    c = GroupFairnessCalibrator(a.method, a.min_samples).fit(df)
    write_table(c.transform(df).select(F.col("score").alias("score_raw"), "score_cal", "y", "g"), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("fairloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version").set_defaults(run=lambda a: print(__version__) or 0)
    for name, run in (("validate", validate), ("check", check)):
        s = sub.add_parser(name)
        s.add_argument("--csv", required=True)
        s.add_argument("--y-true", default="y_true" if name == "check" else None)
        s.add_argument("--y-pred")
        s.add_argument("--score")
        s.add_argument("--sensitive", nargs="+", default=["sensitive"])
        s.add_argument("--backend", default="auto")
        s.add_argument("--min-group-size", type=int, default=30)
        s.add_argument("--nan-policy", default="exclude", choices=["exclude", "include"])
        s.add_argument("--with-ci", action="store_true")
        s.add_argument("--ci-level", type=float, default=0.95)
        s.add_argument("--ci-method", default="percentile", choices=["percentile", "bca"])
        s.add_argument("--bootstrap-b", type=int, default=1000)
        s.add_argument("--with-effects", action="store_true")
        s.add_argument("--threshold", type=float, default=0.10)
        s.add_argument("--title", default="Fairness report")
        s.add_argument("--out")
        s.add_argument("--json", "--out-json")
        s.add_argument("--md", "--out-md", "--report-md")
        s.set_defaults(run=run)
    s = sub.add_parser("sample-check")
    s.add_argument("csv", nargs="?", default="dev_sample.csv")
    s.set_defaults(run=sample_check)
    s = sub.add_parser("pipeline")
    for o in ("--config", "--csv"):
        s.add_argument(o, required=True)
    s.add_argument("--out", "--out-csv")
    s.add_argument("--no-detectors", action="store_true")
    for o in ("--profile", "--detector-json", "--report-md"):
        s.add_argument(o)
    s.set_defaults(run=pipeline)
    s = sub.add_parser("train-lagrangian")
    s.add_argument("--csv", required=True)
    s.add_argument("--out", "--out-json", required=True)
    s.add_argument("--constraint", "--fairness", default="demographic_parity")
    s.add_argument("--tol", type=float)
    for o, v in (("--dp-tol", 0.02), ("--eo-tol", 0.02), ("--model-lr", 1e-3), ("--lambda-lr", 1e-2)):
        s.add_argument(o, type=float, default=v)
    s.add_argument("--epochs", type=int, default=10)
    s.add_argument("--batch-size", type=int, default=0, help="rows of a step, 0 for all")
    s.set_defaults(run=train_lagrangian)
    s = sub.add_parser("train-regularized")
    s.add_argument("--csv", required=True)
    s.add_argument("--out", "--out-json", required=True)
    s.add_argument("--etas", nargs="+", default=["0.0,0.2,0.5,1.0"])
    s.add_argument("--epochs", type=int, default=10)
    s.add_argument("--lr", type=float, default=1e-3)
    s.add_argument("--order", help="column by which the first 80 %% of the rows are trained on")
    s.add_argument("--png", "--out-png")
    s.set_defaults(run=train_regularized)
    s = sub.add_parser("train-reduced")
    s.add_argument("--csv", required=True)
    s.add_argument("--out", "--out-csv", required=True)
    s.add_argument("--constraint", default="demographic_parity")
    s.add_argument("--eps", type=float, default=0.01)
    s.add_argument("--rounds", type=int, default=10)
    s.set_defaults(run=train_reduced)
    s = sub.add_parser("calibrate")
    s.add_argument("--csv", required=True)
    s.add_argument("--out", "--out-csv", required=True)
    s.add_argument("--method", default="platt", choices=["platt", "isotonic"])
    s.add_argument("--min-samples", type=int, default=20)
    s.set_defaults(run=calibrate)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
