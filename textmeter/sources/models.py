"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import SparkSession

from textmeter.sources import versions


def save_model(model: Model, path: str) -> str:
    """Save a new version of the model; those who load meanwhile get the version before."""
    versions.commit(SparkSession.active(), path, lambda _, folder: PipelineModel([model]).save(folder))
    return path


def load_model(path: str) -> Model:
    """The model of the last whole version."""
    _, folder = versions.current(SparkSession.active(), path.rstrip("/"))
    if folder is None:
        raise FileNotFoundError(f"{path}: no model")
    return PipelineModel.load(folder).stages[0]
