"""Training under fairness constraints: a Lagrangian trainer, a sweep over penalty weights, and exponentiated-gradient reductions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.operators.grouping import finite
from fairloom.operators.prefix import running_sum
from fairloom.session import broadcast_if_small
from fairloom.training.network import Adam, backward, forward, init, partition_sums, score, sigmoid

CONSTRAINTS = ("demographic_parity", "equal_opportunity")


def feature_columns(df: DataFrame, prefix: str = "f") -> list[str]:
    """Columns named by the prefix and a number."""
    return [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]


def _sums(params: list[np.ndarray], fair: str):
    """Per batch (x..., y, s): n, loss, hits, and per group s: rows, p and hard p that count for the constraint; then gradients of the loss and of each group's p."""

    def f(m: np.ndarray) -> np.ndarray:
        x, y, s = m[:, :-2], m[:, -2], m[:, -1]
        z, kept = forward(params, x)
        p = sigmoid(z)
        loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
        counts = np.ones(len(y)) if fair == "demographic_parity" else (y == 1).astype(float)
        out = [[len(y), loss.sum(), ((p >= 0.5) == y).sum()]]
        grads = [backward(params, kept, p - y)]
        for v in (0, 1):
            k = counts * (s == v)
            out.append([k.sum(), (k * p).sum(), (k * (p >= 0.5)).sum()])
            grads.append(backward(params, kept, k * p * (1 - p)))
        out.append([p.sum(), s.sum(), (p * s).sum()])
        grads += [backward(params, kept, p * (1 - p)), backward(params, kept, p * (1 - p) * s)]
        return np.concatenate([np.ravel(out), *grads])

    return f


def _rows(df: DataFrame, features: list[str], y: str, s: str, *more: str) -> DataFrame:
    """The rows that can be learnt from."""
    return df.select(*features, y, s, *more).where(F.col(y).isin(0, 1) & F.col(s).isin(0, 1))


@dataclass
class _Pass:
    n: float
    loss: float
    hits: float
    groups: list[tuple[float, float, float]]
    whole: tuple[float, float, float]
    grads: list[np.ndarray]

    @classmethod
    def over(cls, df: DataFrame, cols: list[str], params: list[np.ndarray], fair: str, needed: bool = True) -> _Pass | None:
        v = partition_sums(df, cols, _sums(params, fair))
        if not len(v) and not needed:
            return None
        if not len(v):
            raise ValueError("no complete rows to train on")
        return cls(v[0], v[1], v[2], [tuple(v[3:6]), tuple(v[6:9])], tuple(v[9:12]), np.split(v[12:], 5))

    def gap(self, hard: bool) -> float:
        a, b = (g[2 if hard else 1] / g[0] if g[0] else 0.0 for g in self.groups)
        return b - a


@dataclass
class LagrangianFairnessTrainer:
    """Adam on cross-entropy plus lambda times the violation; lambda rises by its rate times the violation.

    A step takes all rows, or with batch_size about so many: rows fall into batches anew in each epoch, by a hash of the row and the epoch. Rows with a
    missing or infinite value, or a label or group other than 0 and 1, are left out. For equal opportunity the gradient takes the mean probability of positives where the violation takes hard predictions, since those have none.
    """

    hidden: list[int] = field(default_factory=lambda: [16])
    constraint: str = "demographic_parity"
    tol: float = 0.05
    rate: float = 0.05
    dual_rate: float = 0.5
    clip: float = 5.0
    seed: int = 0
    batch_size: int | None = None

    def __post_init__(self):
        if self.constraint not in CONSTRAINTS:
            raise ValueError(f"unknown constraint {self.constraint!r}")
        self.history: list[dict] = []

    def fit(self, df: DataFrame, features: list[str], y: str = "y", s: str = "s", epochs: int = 5) -> LagrangianFairnessTrainer:
        self.features = features
        cols = [*features, y, s]
        rows = _rows(df, features, y, s).persist()
        try:
            self.params = init([len(features), *self.hidden, 1], self.seed)
            adam, lam = Adam(sum(p.size for p in self.params), self.rate), 0.0
            hard = self.constraint == "equal_opportunity"
            batches = max(1, -(-rows.count() // self.batch_size)) if self.batch_size else 1
            for epoch in range(epochs):
                at = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(epoch), *cols), F.lit(batches))
                for i in range(batches):
                    r = _Pass.over(rows.where(at == i) if batches > 1 else rows, cols, self.params, self.constraint, batches == 1)
                    if r is None:
                        continue
                    violation = max(0.0, abs(r.gap(hard)) - self.tol)
                    grad = r.grads[0] / r.n
                    if violation > 0 and lam > 0:
                        side = [g / k[0] if k[0] else g * 0 for g, k in zip(r.grads[1:3], r.groups)]
                        grad = grad + lam * np.sign(r.gap(False)) * (side[1] - side[0])
                    grad *= min(1.0, self.clip / max(np.linalg.norm(grad), 1e-12))
                    self.params = adam.step(self.params, grad)
                    lam = max(0.0, lam + self.dual_rate * violation)
                now = _Pass.over(rows, cols, self.params, self.constraint)
                self.history.append({"epoch": epoch + 1, "accuracy": now.hits / now.n, "violation": max(0.0, abs(now.gap(hard)) - self.tol), "lambda": lam})
        finally:
            rows.unpersist()
        return self

    def transform(self, df: DataFrame, out: str = "logit") -> DataFrame:
        return score(df, self.params, self.features, out)

    def history_json(self) -> str:
        return json.dumps(self.history, indent=2)


def sweep_pareto(df: DataFrame, features: list[str], y: str = "y", s: str = "s", etas: tuple[float, ...] = (0.0, 0.2, 0.5, 1.0), epochs: int = 20, rate: float = 0.01, hidden: int = 32, split: float = 0.8, order: str | None = None, seed: int = 0) -> list[dict]:
    """(eta, accuracy, dp_diff) on held-out rows for each weight of the covariance penalty.

    The first part of the rows in the order column's order is trained on (its split-quantile is the border, ties go to it), without an order a part by a hash of
    the row. Rows that can't be learnt from are left out.
    """
    cols = [*features, y, s]
    rows = _rows(df, features, y, s, *([order] if order and order not in cols else []))
    if order:
        n = rows.where(F.col(order).isNotNull()).count()
        at = rows.groupBy(F.col(order).alias("o__")).agg(F.count("*").alias("n__")).where("o__ is not null")
        border = running_sum(at, ["o__"], "n__", "before__").where(F.col("before__") < split * n).agg(F.max("o__")).first()[0]
        part = F.coalesce(F.col(order) <= F.lit(border), F.lit(False))
    else:
        part = F.pmod(F.xxhash64(*cols), F.lit(10_000)) < int(split * 10_000)
    rows = rows.select(*cols, part.alias("train__")).persist()
    train, held = rows.where("train__").select(*cols), rows.where("not train__").select(*cols)
    out = []
    try:
        for eta in etas:
            params = init([len(features), hidden, 1], seed)
            adam = Adam(sum(p.size for p in params), rate)
            for _ in range(epochs):
                r = _Pass.over(train, cols, params, "demographic_parity")
                p, sv, ps = (v / r.n for v in r.whole)
                slope = (r.grads[4] - sv * r.grads[3]) / r.n
                params = adam.step(params, r.grads[0] / r.n + eta * np.sign(ps - p * sv) * slope)
            v = _Pass.over(held, cols, params, "demographic_parity")
            out.append({"eta": eta, "accuracy": v.hits / v.n, "dp_diff": abs(v.gap(False))})
    finally:
        rows.unpersist()
    return out


def plot_pareto(points: list[dict], save_path: str | None = None):
    """A scatter of accuracy against dp_diff; needs matplotlib."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plot_pareto needs matplotlib") from e
    fig, ax = plt.subplots()
    ax.scatter([p["dp_diff"] for p in points], [p["accuracy"] for p in points])
    for p in points:
        ax.annotate(f"η={p['eta']}", (p["dp_diff"], p["accuracy"]))
    ax.set_xlabel("demographic parity gap")
    ax.set_ylabel("accuracy")
    if save_path:
        fig.savefig(save_path)
    return fig


class ReductionsWrapper:
    """Exponentiated-gradient reduction (Agarwal et al. 2018): a mixture of weighted fits that keeps the groups' rates within eps.

    The inner learner is logistic regression of pyspark.ml; each round is one weighted fit and one grouped aggregate of the mean predictions.
    """

    def __init__(self, constraint: str = "demographic_parity", eps: float = 0.01, T: int = 10, eta: float = 2.0, bound: float = 10.0, estimator=None):
        if constraint not in (*CONSTRAINTS, "equalized_odds"):
            raise ValueError(f"unknown constraint {constraint!r}")
        self.constraint, self.eps, self.T, self.eta, self.bound, self.estimator = constraint, eps, T, eta, bound, estimator
        self.models: list = []

    def _event(self, y: str):
        """Rows are compared with all rows of the same event."""
        if self.constraint == "demographic_parity":
            return F.lit("all")
        if self.constraint == "equal_opportunity":
            return F.when(F.col(y) == 1, F.lit("1"))
        return F.col(y).cast("string")

    def fit(self, df: DataFrame, features: list[str], y: str = "y", s: str = "s") -> ReductionsWrapper:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        self.features = features
        rows = df.select(*[finite(df, f).alias(f) for f in features], F.col(y).cast("double").alias("y__"), F.col(s).cast("string").alias("s__")).dropna()
        rows = VectorAssembler(inputCols=features, outputCol="x__").transform(rows).withColumn("e__", self._event("y__")).select("x__", "y__", "s__", "e__").persist()
        try:
            cells = [(r[0], r[1], r[2]) for r in rows.where("e__ is not null").groupBy("e__", "s__").agg(F.count("*")).collect()]  # one row per group
            events: dict[str, int] = {}
            for e, _, n in cells:
                events[e] = events.get(e, 0) + n
            total = rows.count()
            theta = {(e, g, sign): 0.0 for e, g, _ in cells for sign in (1, -1)}
            base = self.estimator or LogisticRegression(featuresCol="x__", labelCol="l__", weightCol="w__", maxIter=30)
            for _ in range(self.T):
                z = 1 + sum(np.exp(np.clip(t, -50, 50)) for t in theta.values())
                lam = {k: self.bound * float(np.exp(np.clip(t, -50, 50)) / z) for k, t in theta.items()}
                # cost of predicting 1 rather than 0: the error's and the constraint's
                signed = {(e, g): lam[e, g, 1] - lam[e, g, -1] for e, g, _ in cells}
                whole = dict.fromkeys(events, 0.0)
                for (e, _), v in signed.items():
                    whole[e] += v
                cost = [(e, g, float(signed[e, g] * total / n - whole[e] * total / events[e])) for e, g, n in cells]
                costs = broadcast_if_small(df.sparkSession.createDataFrame(cost, "c_e string, c_s string, c__ double"), len(cost))
                rows_c = rows.join(costs, (F.col("e__") == F.col("c_e")) & (F.col("s__") == F.col("c_s")), "left")
                c = F.coalesce("c__", F.lit(0.0)) + (1 - 2 * F.col("y__"))
                fit_rows = rows_c.withColumn("l__", (c < 0).cast("double")).withColumn("w__", F.abs(c))
                model = base.fit(fit_rows)
                self.models.append(model)
                hit = model.transform(rows.select("x__", "s__", "e__", F.col("y__").alias("l__"))).where("e__ is not null").groupBy("e__", "s__").agg(F.sum("prediction")).collect()
                got = {(r[0], r[1]): r[2] for r in hit}
                rate = dict.fromkeys(events, 0.0)
                for (e, _), v in got.items():
                    rate[e] += v / events[e]
                for e, g, n in cells:
                    d = got[e, g] / n - rate[e]
                    theta[e, g, 1] += self.eta * (d - self.eps)
                    theta[e, g, -1] += self.eta * (-d - self.eps)
        finally:
            rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame, out: str = "probability_fair") -> DataFrame:
        """df with the mixture's probability of 1: the models' mean; NULL where a feature is missing or infinite."""
        if not self.models:
            raise RuntimeError("fit first")
        from pyspark.ml.functions import array_to_vector, vector_to_array

        xs = [finite(df, f) for f in self.features]
        d = df.withColumn("x__", array_to_vector(F.array(*[F.coalesce(x, F.lit(0.0)) for x in xs]))).withColumn("ok__", ~reduce(lambda a, b: a | b, [x.isNull() for x in xs]))
        p = F.lit(0.0)
        for i, m in enumerate(self.models):
            d = m.setPredictionCol(f"y{i}__").setProbabilityCol(f"p{i}__").setRawPredictionCol(f"r{i}__").transform(d)
            p = p + vector_to_array(F.col(f"p{i}__"))[1]
        drop = [f"{k}{i}__" for i in range(len(self.models)) for k in "ypr"]
        return d.withColumn(out, F.when(F.col("ok__"), p / len(self.models))).drop("x__", "ok__", *drop)

    def predict(self, df: DataFrame, out: str = "prediction_fair") -> DataFrame:
        return self.predict_proba(df, "p__").withColumn(out, (F.col("p__") >= 0.5).cast("int")).drop("p__")
