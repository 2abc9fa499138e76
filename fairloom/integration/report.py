"""Markdown and JSON reports, the fairness assertion, and the MLflow sink."""

from __future__ import annotations

import json
import operator
from dataclasses import asdict
from datetime import datetime, timezone
from math import isfinite, isnan

from fairloom.operators.metrics import MetricResult

_COMPARE = {"<=": operator.le, "<": operator.lt, ">=": operator.ge, ">": operator.gt}


def _number(v: float | None, digits: int) -> str:
    return "—" if v is None or isnan(v) else f"{v:.{digits}f}"


def to_markdown_report(results: dict[str, MetricResult] | list[MetricResult], title: str = "Fairness report", level: float = 0.95) -> str:
    rows = list(results.values()) if isinstance(results, dict) else list(results)
    out = [f"# {title}", "", f"Generated: {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} UTC", "", f"| Metric | Value | {level:.0%} CI | Effect | n_per_group |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        ci = "—" if not r.ci else f"[{_number(r.ci[0], 4)}, {_number(r.ci[1], 4)}]"
        n = ", ".join(f"{k}: {v}" for k, v in sorted(r.n_per_group.items()))
        out.append(f"| {r.metric} | {_number(r.value, 6)} | {ci} | {_number(r.effect_size, 6)} | {n} |")
    return "\n".join(out) + "\n"


def to_json_report(results: list[MetricResult]) -> str:
    return json.dumps([asdict(r) for r in results], ensure_ascii=False, indent=2)


def pipeline_markdown(config: str, source: str, target: str, report: dict) -> str:
    parts = "\n".join(f"- {k}: {len(v)} entries" for k, v in report.items())
    return f"# Pipeline run\n\n- config: {config}\n- input: {source}\n- output: {target}\n{parts}\n"


def assert_fairness(value: float | None, threshold: float, *, comparator: str = "<=", allow_nan: bool = False, context: str | None = None) -> None:
    """Raises AssertionError unless the value compares as wanted; a missing value fails unless allowed."""
    if comparator not in _COMPARE:
        raise ValueError(f"unknown comparator {comparator!r}")
    where = f" ({context})" if context else ""
    if value is None or isnan(value):
        if not allow_nan:
            raise AssertionError(f"the value is missing{where}")
    elif not _COMPARE[comparator](value, threshold):
        raise AssertionError(f"{value:.6f} {comparator} {threshold:.6f} does not hold{where}")


def log_fairness_metrics(results: dict[str, MetricResult], *, prefix: str = "fairness", artifact_name: str = "fairness.json", artifact_content: str | None = None) -> bool:
    """Values as MLflow metrics, intervals, effects and sizes as parameters, all of it as an artifact; False where MLflow is missing."""
    try:
        import mlflow
    except ImportError:
        return False
    for name, r in results.items():
        if r.value is not None and isfinite(r.value):
            mlflow.log_metric(f"{prefix}.{name}.value", r.value)
        for k in ("ci", "effect_size", "n_per_group"):
            mlflow.log_param(f"{prefix}.{name}.{k}", json.dumps(getattr(r, k)))
    mlflow.log_text(artifact_content or to_json_report(list(results.values())), artifact_name)
    return True
