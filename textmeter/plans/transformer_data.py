"""The table side of a transformer run: samples, validation split, evaluation.

Training happens elsewhere; its predictions come in as ``(id, y_true, scores)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textmeter import resources as R
from textmeter.operators import evaluation as E, splits as S
from textmeter.operators.models import argmax_prediction
from textmeter.sources.tables import upsert_result


def transformer_data(df: DataFrame, train_size: int | None = None, test_size: int | None = None,
                     balanced: bool = True, seed: int = R.SEED) -> DataFrame:
    """``df`` (with ``split`` train/test) reduced to the sizes asked for, with train split into train and val.

    ``balanced`` forces equal classes and takes the tail as validation; otherwise
    both sample and validation keep class proportions, and test is left whole.
    The tail is taken in another order than the sample was drawn by.
    """
    train = df.filter("split = 'train'").drop("split")
    test = df.filter("split = 'test'").drop("split")
    if balanced:
        train = S.tail_validation_split(S.balanced_sample(train, train_size, seed=seed), seed=seed + 1)
        test = S.balanced_sample(test, test_size, seed=seed)
    else:
        train = S.stratified_validation_split(S.proportional_sample(train, train_size, seed=seed), seed=seed)
    return train.unionByName(test.withColumn("split", F.lit("test")))


@dataclass(frozen=True)
class TransformerReport:
    metrics: DataFrame
    report: DataFrame
    comparison: DataFrame
    results: DataFrame


def evaluate_transformer(scored: DataFrame, baseline: DataFrame, results: DataFrame | None,
                         model: str = "DistilBERT", features: str = "Contextual Embeddings") -> TransformerReport:
    """Metrics of the predictions, per-class report, difference to the baseline row, and the extended results."""
    preds = argmax_prediction(scored)
    measured = E.classification_metrics(preds).select(F.lit(model).alias("Model"), F.lit(features).alias("Features"), "*")
    return TransformerReport(
        measured,
        E.classification_report(preds),
        E.baseline_delta(baseline, measured),
        upsert_result(results, E.results_table(measured)),
    )
