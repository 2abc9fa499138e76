"""Pipeline configuration in YAML, with profiles, and the stages it names."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame

from fairloom.operators.detectors import BiasReport, run_detectors
from fairloom.operators.mitigation import DisparateImpactRemover, InstanceReweighting, ProxyDropper, ReweighingTransformer

PROFILE_VARIABLE = "FAIRLOOM_PROFILE"
TRANSFORMERS = {c.__name__: c for c in (InstanceReweighting, ReweighingTransformer, DisparateImpactRemover, ProxyDropper)}
# Names of older configurations.
ALIASES = {"disparate_impact": "DisparateImpactRemover", "reweighing": "ReweighingTransformer", "instance_reweighting": "InstanceReweighting", "proxy_dropper": "ProxyDropper"}


@dataclass
class PipelineStep:
    name: str
    transformer: str
    params: dict = field(default_factory=dict)


@dataclass
class PipelineConfig:
    sensitive: list[str] = field(default_factory=list)
    benchmarks: dict[str, dict[str, float]] = field(default_factory=dict)
    alpha: float = 0.05
    proxy_threshold: float = 0.30
    report_out: str | None = None
    pipeline: list[PipelineStep] = field(default_factory=list)


def load_config(path: str | None = None, *, text: str | None = None, obj: dict | None = None, profile: str | None = None) -> PipelineConfig:
    """From exactly one of path, text and obj. The profile is the argument, the environment's, 'pipeline' or the only one; it overrides the shared keys."""
    if sum(x is not None for x in (path, text, obj)) != 1:
        raise ValueError("give exactly one of path, text and obj")
    if obj is None:
        import yaml

        if path is not None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        obj = yaml.safe_load(text) or {}
    if not isinstance(obj, dict):
        raise ValueError("the configuration must be a mapping")
    profiles = obj.get("profiles") or {}
    flat = {k: v for k, v in obj.items() if k != "profiles"}
    chosen = profile or os.environ.get(PROFILE_VARIABLE)
    if profiles:
        if chosen is None:
            chosen = "pipeline" if "pipeline" in profiles else next(iter(profiles)) if len(profiles) == 1 else None
        if chosen not in profiles:
            raise ValueError(f"profile {chosen!r} is not one of {', '.join(profiles)}")
        flat |= profiles[chosen] or {}
    elif profile:
        raise ValueError(f"the configuration has no profile {profile!r}")
    return _config(flat)


def _config(d: dict) -> PipelineConfig:
    steps = []
    for i, s in enumerate(d.get("pipeline", d.get("steps")) or []):
        kind = s.get("transformer") or s.get("kind")
        if not kind:
            raise ValueError(f"step {i} names no transformer")
        kind = ALIASES.get(kind, kind)
        steps.append(PipelineStep(s.get("name") or f"{kind}_{i}", kind, dict(s.get("params") or {})))
    sensitive = d.get("sensitive") or []
    sensitive = [sensitive] if isinstance(sensitive, str) else list(sensitive)
    bench = {a: {str(k): float(v) for k, v in (b or {}).items()} for a, b in (d.get("benchmarks") or {}).items()}
    return PipelineConfig(sensitive, bench, float(d.get("alpha", 0.05)), float(d.get("proxy_threshold", 0.30)), d.get("report_out"), steps)


def build_stage(step: PipelineStep, cfg: PipelineConfig):
    if step.transformer not in TRANSFORMERS:
        raise ValueError(f"unknown transformer {step.transformer!r}")
    p = dict(step.params)
    if step.transformer == "DisparateImpactRemover":
        if "features" not in p:
            raise ValueError(f"{step.name}: features are needed")
        if "sensitive" not in p:
            if len(cfg.sensitive) != 1:
                raise ValueError(f"{step.name}: name one sensitive column")
            p["sensitive"] = cfg.sensitive[0]
    else:
        p.setdefault("sensitive", cfg.sensitive)
        if step.transformer != "ProxyDropper":
            p.setdefault("benchmarks", cfg.benchmarks)
    return TRANSFORMERS[step.transformer](**p)


def build_pipeline(cfg: PipelineConfig) -> Pipeline:
    if not cfg.pipeline:
        raise ValueError("the configuration has no steps")
    return Pipeline(stages=[build_stage(s, cfg) for s in cfg.pipeline])


def apply_pipeline(cfg: PipelineConfig, df: DataFrame) -> DataFrame:
    """Each stage fitted on what the one before gave; weights are columns of the result."""
    return build_pipeline(cfg).fit(df).transform(df)


def detect(cfg: PipelineConfig, df: DataFrame) -> BiasReport:
    report = run_detectors(df, cfg.sensitive, cfg.benchmarks, cfg.alpha, cfg.proxy_threshold)
    if cfg.report_out:
        report.to_json(cfg.report_out)
    return report
