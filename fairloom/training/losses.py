"""Losses and constraint violations of scored tables, as single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.functions.scalar import bce_with_logits, binarize, sigmoid

MODES = ("covariance", "mean_gap")


def _side(p, s, v):
    return F.avg(F.when(s == v, p))


def fairness_penalty(logit: str, s: str, mode: str = "covariance"):
    """Aggregate: |cov(p, S)|, or the squared gap of the two groups' mean p (0 if one is absent)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    p, sv = sigmoid(F.col(logit)), F.col(s)
    if mode == "covariance":
        return F.abs(F.covar_pop(p, sv.cast("double")))
    return F.coalesce((_side(p, sv, 0) - _side(p, sv, 1)) ** 2, F.lit(0.0))


def regularized_loss(df: DataFrame, logit: str, y: str, s: str, eta: float = 0.5, mode: str = "covariance", pos_weight: float | None = None) -> DataFrame:
    """(bce, penalty, loss) of a table of logits."""
    a = df.agg(F.avg(bce_with_logits(F.col(logit), F.col(y).cast("double"), pos_weight)).alias("bce"), fairness_penalty(logit, s, mode).alias("penalty"))
    return a.withColumn("loss", F.col("bce") + eta * F.col("penalty"))


def demographic_parity_violation(df: DataFrame, logit: str, s: str, tol: float = 0.0) -> DataFrame:
    p, sv = sigmoid(F.col(logit)), F.col(s)
    side = lambda v: F.coalesce(_side(p, sv, v), F.lit(0.0))
    return df.agg((F.abs(side(1) - side(0)) - tol).alias("violation"))


def equal_opportunity_violation(df: DataFrame, logit: str, y: str, s: str, tol: float = 0.0) -> DataFrame:
    """On hard predictions at 0.5, among the rows with label 1."""
    hard, sv = binarize(sigmoid(F.col(logit))).cast("double"), F.when(F.col(y) == 1, F.col(s))
    side = lambda v: F.coalesce(_side(hard, sv, v), F.lit(0.0))
    return df.agg((F.abs(side(1) - side(0)) - tol).alias("violation"))


class FairnessRegularizerLoss:
    """regularized_loss with its settings kept; calling it gives the loss as a number."""

    def __init__(self, eta: float = 0.5, mode: str = "covariance", pos_weight: float | None = None):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.eta, self.mode, self.pos_weight = eta, mode, pos_weight

    def __call__(self, df: DataFrame, logit: str = "logit", y: str = "y", s: str = "s") -> float:
        return regularized_loss(df, logit, y, s, self.eta, self.mode, self.pos_weight).first()["loss"]
