"""Writing fitted stages to a folder and reading them back: settings as JSON, tables as Parquet, so that they outlive their session."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from fairloom.operators.mitigation import DropModel, RepairModel, WeightModel
from fairloom.training.calibration import GroupFairnessCalibrator
from fairloom.training.trainers import LagrangianFairnessTrainer


def _write(spark: SparkSession, path: str, settings: dict, tables: dict[str, DataFrame]) -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def save(model, path: str, spark: SparkSession) -> None:
    """Writes a fitted stage: weights, repair, dropped columns, calibrator or trained network."""
    kind = type(model).__name__
    if isinstance(model, WeightModel):
        _write(spark, path, {"kind": kind, "attributes": model.attributes, "n_cells": model.n_cells, "out": model.out}, {"cells": model.cells} if model.attributes else {})
    elif isinstance(model, RepairModel):
        pools = [{"feature": f, "n": n} for f, (_, n) in model.pools.items()]
        _write(spark, path, {"kind": kind, "sensitive": model.sensitive, "repair_level": model.repair_level, "min_group_size": model.min_group_size, "pools": pools}, {f"pool{i}": p for i, (p, _) in enumerate(model.pools.values())})
    elif isinstance(model, DropModel):
        _write(spark, path, {"kind": kind, "dropped": model.dropped, "scores": model.scores}, {})
    elif isinstance(model, GroupFairnessCalibrator):
        _write(spark, path, {"kind": kind, "method": model.method, "min_samples": model.min_samples, "score": model.score, "group": model.group}, {"model": model.model})
    elif isinstance(model, LagrangianFairnessTrainer):
        _write(spark, path, {"kind": kind, "hidden": model.hidden, "constraint": model.constraint, "features": model.features, "history": model.history, "params": [p.tolist() for p in model.params]}, {})
    else:
        raise ValueError(f"{kind} can't be saved")


def load(path: str, spark: SparkSession):
    """The stage that save() wrote."""
    s = json.loads(spark.read.text(f"{path}/settings").first()[0])
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    if s["kind"] == "WeightModel":
        return WeightModel(s["attributes"], table("cells") if s["attributes"] else None, s["n_cells"], s["out"])
    if s["kind"] == "RepairModel":
        return RepairModel(s["sensitive"], {p["feature"]: (table(f"pool{i}"), p["n"]) for i, p in enumerate(s["pools"])}, s["repair_level"], s["min_group_size"])
    if s["kind"] == "DropModel":
        return DropModel(s["dropped"], s["scores"])
    if s["kind"] == "GroupFairnessCalibrator":
        c = GroupFairnessCalibrator(s["method"], s["min_samples"])
        c.score, c.group, c.model = s["score"], s["group"], table("model")
        return c
    import numpy as np

    t = LagrangianFairnessTrainer(hidden=s["hidden"], constraint=s["constraint"])
    t.features, t.history, t.params = s["features"], s["history"], [np.array(p) for p in s["params"]]
    return t
