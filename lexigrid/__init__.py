"""Text classification experiments as Spark DataFrame jobs."""

from lexigrid.plans.estimator_experiment import EstimatorExperiment, FittedEstimators, load_estimators
from lexigrid.plans.experiment import Experiment, ExperimentConfig, FittedExperiment, load_experiment
from lexigrid.plans.serve import classify
from lexigrid.sources.readers import chain, read_csv, read_docs, read_texts
from lexigrid.sources.registry import Registry

__all__ = [
    "EstimatorExperiment", "Experiment", "ExperimentConfig", "FittedEstimators", "FittedExperiment", "Registry",
    "chain", "classify", "load_estimators", "load_experiment", "read_csv", "read_docs", "read_texts",
]
