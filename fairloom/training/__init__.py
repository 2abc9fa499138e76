"""Training and post-processing under fairness constraints."""

from fairloom.training.calibration import GroupFairnessCalibrator
from fairloom.training.losses import FairnessRegularizerLoss
from fairloom.training.trainers import LagrangianFairnessTrainer, ReductionsWrapper, plot_pareto, sweep_pareto

__all__ = ["FairnessRegularizerLoss", "GroupFairnessCalibrator", "LagrangianFairnessTrainer", "ReductionsWrapper", "plot_pareto", "sweep_pareto"]
