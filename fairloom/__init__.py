"""fairloom: group-fairness analytics and data preparation on Spark."""

__version__ = "0.1.0"

from fairloom.functions.bootstrap import bca_interval, bootstrap_ci
from fairloom.functions.scalar import benjamini_hochberg, bonferroni, cohens_d, risk_ratio
from fairloom.functions.special import beta_binomial_interval
from fairloom.integration.report import assert_fairness, log_fairness_metrics, to_markdown_report
from fairloom.operators.detectors import BiasReport, ProxyVariableDetector, RepresentationBiasDetector, StatisticalDisparityDetector, run_detectors
from fairloom.operators.grouping import group_sizes, min_group_mask
from fairloom.operators.grouping import label as build_intersectional_labels
from fairloom.operators.metrics import FairnessAnalyzer, MetricResult
from fairloom.operators.mitigation import DisparateImpactRemover, InstanceReweighting, ProxyDropper, ReweighingTransformer
from fairloom.pipeline.config import apply_pipeline, build_pipeline, load_config

__all__ = [
    "BiasReport", "DisparateImpactRemover", "FairnessAnalyzer", "InstanceReweighting", "MetricResult", "ProxyDropper", "ProxyVariableDetector", "RepresentationBiasDetector",
    "ReweighingTransformer", "StatisticalDisparityDetector", "apply_pipeline", "assert_fairness", "bca_interval", "benjamini_hochberg", "beta_binomial_interval", "bonferroni",
    "bootstrap_ci", "build_intersectional_labels", "build_pipeline", "cohens_d", "group_sizes", "load_config", "log_fairness_metrics", "min_group_mask", "risk_ratio",
    "run_detectors", "to_markdown_report",
]
