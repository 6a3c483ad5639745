"""Confusion counts, the metrics built on them, comparisons and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from textmeter import resources as R
from textmeter.functions import text as X


def confusion_matrix(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TP, TN, FP, FN in one aggregate, also when only one class occurs; one row per group of ``by``."""
    t, p = F.col("y_true"), F.col("y_pred")
    return preds.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("TP"),
        F.count_if((t == 0) & (p == 0)).alias("TN"),
        F.count_if((t == 0) & (p == 1)).alias("FP"),
        F.count_if((t == 1) & (p == 0)).alias("FN"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """Add the eleven ratios, rounded to four digits, to confusion counts."""
    # Doubles throughout: the product of four margins overflows a bigint.
    tp, tn, fp, fn = (F.col(c).cast("double") for c in R.COUNT_METRICS)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    ratios = {
        "Accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "Precision": precision,
        "Recall": recall,
        "F1-Score": _ratio(2 * precision * recall, precision + recall),
        "MCC": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "Sensitivity": recall,
        "Specificity": _ratio(tn, tn + fp),
        "FPR": _ratio(fp, tn + fp),
        "FNR": _ratio(fn, tp + fn),
        "NPV": _ratio(tn, tn + fn),
        "FDR": _ratio(fp, tp + fp),
    }
    return counts.withColumns({name: F.round(ratios[name], 4) for name in R.RATIO_METRICS})


def classification_metrics(preds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All fifteen metrics, one row per group of ``by``."""
    return metrics(confusion_matrix(preds, by)).select(*by, *R.RATIO_METRICS, *R.COUNT_METRICS)


def basic_metrics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Five metrics from per-class scores: the class is the position of the largest one."""
    preds = scored.withColumn("y_pred", X.argmax(F.col("scores")))
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1-Score", "mcc": "MCC"}
    table = classification_metrics(preds, by)
    return table.select(*by, *[F.col(f"`{column}`").alias(name) for name, column in names.items()])


def classification_report(preds: DataFrame, names: tuple[str, str] = ("Negative", "Positive")) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    c = confusion_matrix(preds)
    tp, tn, fp, fn = (F.col(x).cast("double") for x in R.COUNT_METRICS)

    def measures(hit, wrongly, missed):
        p, r = _ratio(hit, hit + wrongly), _ratio(hit, hit + missed)
        return p, r, _ratio(2 * p * r, p + r), hit + missed

    neg, pos = measures(tn, fn, fp), measures(tp, fp, fn)
    n = neg[3] + pos[3]
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(neg[:3], pos[:3])]
    weighted = [_ratio(a * neg[3] + b * pos[3], n) for a, b in zip(neg[:3], pos[:3])]

    def line(name, p, r, f1, support):
        fields = [F.lit(name).alias("name")]
        fields += [F.round(x, 4).alias(a) for x, a in ((p, "precision"), (r, "recall"), (f1, "f1"))]
        return F.struct(*fields, support.cast("bigint").alias("support"))

    nothing = F.lit(None).cast("double")
    lines = [
        line(names[0], *neg), line(names[1], *pos), line("accuracy", nothing, nothing, accuracy, n),
        line("macro avg", *macro, n), line("weighted avg", *weighted, n),
    ]
    return c.select(F.inline(F.array(*lines)))


def results_table(experiments: DataFrame) -> DataFrame:
    """The thirteen columns of the results table, in order."""
    return experiments.select(*[F.col(f"`{c}`") for c in R.RESULT_COLUMNS])


def best_experiment(results: DataFrame, order: str | None = None) -> DataFrame:
    """The row with the highest F1; among equals the first by ``order``, else by model and features."""
    ties = [order] if order else ["Model", "Features"]
    return results.orderBy(F.desc("F1-Score"), *ties).limit(1)


def mcc_matrix(results: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Models down, features across, MCC inside, 0 where an experiment is missing."""
    pivoted = results.groupBy("Model")
    pivoted = pivoted.pivot("Features", sorted(features)) if features else pivoted.pivot("Features")
    return pivoted.agg(F.first("MCC")).fillna(0.0)


def _unpivot(results: DataFrame, metrics: tuple[str, ...], ids: list[str]) -> DataFrame:
    quoted = [F.col(f"`{m}`") for m in metrics]
    return results.select(*ids, *quoted).unpivot(ids, [f"`{m}`" for m in metrics], "metric", "value")


def metric_series(results: DataFrame, metrics: tuple[str, ...] = ("Accuracy", "F1-Score", "MCC")) -> DataFrame:
    """(label, metric, value), one row per bar of the comparison."""
    labelled = results.withColumn("label", F.concat("Model", F.lit(" ("), "Features", F.lit(")")))
    return _unpivot(labelled, metrics, ["label"])


def metric_grid(results: DataFrame, metrics: tuple[str, ...] = ("Accuracy", "Precision", "Recall")) -> DataFrame:
    """(Features, Model, metric, value) for every pair of features and model, 0 where it is missing.

    A results table holds one row per experiment, so its names fit in one row.
    """
    names = results.agg(F.collect_set("Model").alias("m"), F.collect_set("Features").alias("f"))
    pairs = names.select(F.explode("m").alias("Model"), "f").select("Model", F.explode("f").alias("Features"))
    whole = pairs.join(results, ["Model", "Features"], "left").fillna(0.0)
    return _unpivot(whole, metrics, ["Features", "Model"])


def stability_by_model(results: DataFrame) -> DataFrame:
    """Mean, extremes and spread of MCC over the feature sets of each model."""
    mcc = F.col("MCC")
    return results.groupBy("Model").agg(
        F.round(F.avg(mcc), 4).alias("avg_mcc"),
        F.min(mcc).alias("min_mcc"),
        F.max(mcc).alias("max_mcc"),
        F.round(F.max(mcc) - F.min(mcc), 4).alias("range_mcc"),
        F.round(F.stddev_pop(mcc), 4).alias("std_mcc"),
    )


def baseline_delta(baseline: DataFrame, new: DataFrame, metrics: tuple[str, ...] = R.COMPARED_METRICS) -> DataFrame:
    """(metric, baseline, value, delta, verdict) of two one-row results."""
    old = _unpivot(baseline, metrics, []).withColumnRenamed("value", "baseline")
    both = old.join(_unpivot(new, metrics, []), "metric")
    delta = F.round(F.col("value") - F.col("baseline"), 4)
    return both.select(
        "metric", "baseline", "value", delta.alias("delta"), F.when(delta > 0, "better").otherwise("behind").alias("verdict")
    )


def _outcome() -> Column:
    return F.when(F.col("y_true") == F.col("y_pred"), "Correct").otherwise("Misclassified")


def error_analysis(preds: DataFrame) -> DataFrame:
    """Correct against misclassified rows: number, share, mean cleaned length, mean negations in the raw text.

    Empty when nothing is misclassified.
    """
    measured = preds.select(
        _outcome().alias("outcome"),
        X.word_count(F.col("cleaned_review")).alias("_length"),
        X.negation_count(F.col("review")).alias("_negations"),
    )
    groups = measured.groupBy("outcome").agg(
        F.count("*").alias("n"), F.avg("_length").alias("_l"), F.avg("_negations").alias("_g")
    )
    # Two rows at most.
    both = W.partitionBy(F.lit(1))
    return (
        groups.withColumn("_total", F.sum("n").over(both))
        .withColumn("_wrong", F.count_if(F.col("outcome") == "Misclassified").over(both))
        .filter("_wrong > 0")
        .select(
            "outcome", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("share"),
            F.round("_l", 4).alias("avg_length"), F.round("_g", 4).alias("avg_negations"),
        )
    )


def error_length_histogram(preds: DataFrame, bins: int = 40) -> DataFrame:
    """Lengths of correct and of misclassified rows, each over its own range."""
    from textmeter.operators.eda import histogram, length_counts

    lengths = length_counts(preds.withColumn("outcome", _outcome()), "cleaned_review", "outcome")
    return histogram(lengths, "outcome", bins)
