"""A small network whose gradients are sums over partitions: executors add them up, the driver takes the steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.operators.grouping import finite


def init(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Weights and biases of layers, uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:]):
        k = 1 / np.sqrt(a)
        out += [rng.uniform(-k, k, (a, b)), rng.uniform(-k, k, b)]
    return out


def forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits and the layers' inputs."""
    kept, h = [], x
    for i in range(0, len(params), 2):
        kept.append(h)
        h = h @ params[i] + params[i + 1]
        if i + 2 < len(params):
            h = np.maximum(h, 0)
    return h[:, 0], kept


def backward(params: list[np.ndarray], kept: list[np.ndarray], slope: np.ndarray) -> np.ndarray:
    """The gradient, flat, of a loss with the given slope at each logit."""
    out: list[np.ndarray] = []
    g = slope[:, None]
    for i in range(len(params) - 2, -1, -2):
        h = kept[i // 2]
        out = [(h.T @ g).ravel(), g.sum(0), *out]
        if i:
            g = (g @ params[i].T) * (h > 0)
    return np.concatenate(out)


def unflat(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def partition_sums(df: DataFrame, cols: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of fn, which maps a matrix of the columns to a vector of fixed length. One short vector per partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = fn(np.column_stack([np.asarray(b.column(i), dtype=float) for i in range(len(cols))]))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    doubles = df.select(*[finite(df, c).alias(str(i)) for i, c in enumerate(cols)]).dropna()
    rows = doubles.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # parameters, not rows
    return np.array([r["v"] for r in rows])


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, params: list[np.ndarray], grad: np.ndarray) -> list[np.ndarray]:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        move = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return [p - d for p, d in zip(params, unflat(move, params))]


def score(df: DataFrame, params: list[np.ndarray], features: list[str], out: str = "logit") -> DataFrame:
    """df with the network's logit as a column."""

    @F.pandas_udf("double")
    def f(*cols: pd.Series) -> pd.Series:
        return pd.Series(forward(params, np.column_stack([np.asarray(c, float) for c in cols]))[0])

    return df.withColumn(out, f(*[F.col(f"`{c}`").cast("double") for c in features]))
