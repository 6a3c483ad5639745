import math

import pytest
from pyspark.sql import functions as F

from textmeter import resources as R
from textmeter.operators import evaluation as E, quality as Q

# Model, features, TP, FP, FN, TN and the published accuracy, precision, MCC and NPV.
GRID = [
    ("LR", "Hybrid", 4503, 551, 497, 4449, 0.8952, 0.8910, 0.7904, 0.8995),
    ("LR", "TF-IDF", 4515, 566, 485, 4434, 0.8949, 0.8886, 0.7899, 0.9014),
    ("SVM", "Hybrid", 4474, 560, 526, 4440, 0.8914, 0.8888, 0.7828, 0.8941),
    ("SVM", "TF-IDF", 4456, 565, 544, 4435, 0.8891, 0.8875, 0.7782, 0.8907),
    ("SVM", "Word2Vec", 4386, 677, 614, 4323, 0.8709, 0.8663, 0.7419, 0.8756),
    ("LR", "Word2Vec", 4378, 673, 622, 4327, 0.8705, 0.8668, 0.7410, 0.8743),
    ("LR", "BoW", 4365, 656, 635, 4344, 0.8709, 0.8693, 0.7418, 0.8725),
    ("RF", "BoW", 4386, 834, 614, 4166, 0.8552, 0.8402, 0.7111, 0.8715),
    ("RF", "TF-IDF", 4344, 823, 656, 4177, 0.8521, 0.8407, 0.7046, 0.8643),
    ("RF", "Word2Vec", 4381, 863, 619, 4137, 0.8518, 0.8354, 0.7044, 0.8698),
    ("SVM", "BoW", 4219, 733, 781, 4267, 0.8486, 0.8520, 0.6972, 0.8453),
    ("RF", "Hybrid", 4235, 832, 765, 4168, 0.8403, 0.8358, 0.6807, 0.8449),
]


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, *r[:6]) for i, r in enumerate(GRID)]
    counts = spark.createDataFrame(rows, "run int, Model string, Features string, TP long, FP long, FN long, TN long")
    return E.metrics(counts)


def test_published_grid(grid):
    got = {(r.Model, r.Features): (r.Accuracy, r.Precision, r.MCC, r.NPV) for r in grid.collect()}
    assert got == {(r[0], r[1]): r[6:] for r in GRID}


def test_best_and_stability(grid):
    best = E.best_experiment(grid, "run").first()
    assert (best.Model, best.Features) == ("LR", "Hybrid")
    spread = {r.Model: (r.avg_mcc, r.range_mcc) for r in E.stability_by_model(grid).collect()}
    assert spread == {"LR": (0.7658, 0.0494), "SVM": (0.7500, 0.0856), "RF": (0.7002, 0.0304)}


def test_matrix_and_grid_fill_gaps_with_zero(grid):
    some = grid.filter("NOT (Model = 'RF' AND Features = 'BoW')")
    matrix = {r.Model: r.asDict() for r in E.mcc_matrix(some).collect()}
    assert list(matrix["LR"]) == ["Model", "BoW", "Hybrid", "TF-IDF", "Word2Vec"]
    assert matrix["RF"]["BoW"] == 0.0 and matrix["RF"]["Hybrid"] == 0.6807
    cells = E.metric_grid(some)
    assert cells.count() == 3 * 4 * 3
    assert cells.filter("value = 0").count() == 3


def test_results_table_columns(grid):
    assert E.results_table(grid).columns == list(R.RESULT_COLUMNS)


def preds(table, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return table(rows, "y_true int, y_pred int")


def test_per_class_report(table):
    counts = table([(4443, 4553, 387, 534)], "TP long, TN long, FP long, FN long")
    report = {r.name: r for r in E.classification_report(preds(table, 444, 39, 53, 455)).collect()}
    assert report["Positive"].support == 497 and report["Negative"].support == 494
    assert report["accuracy"].f1 == round(899 / 991, 4) and report["accuracy"].precision is None
    m = E.metrics(counts).first()
    assert (m.Accuracy, m.Precision, m.Recall, m["F1-Score"], m.MCC) == (0.9071, 0.9199, 0.8927, 0.9061, 0.8146)


def test_only_one_class(table):
    m = E.classification_metrics(preds(table, 3, 0, 0, 0)).first()
    assert (m.Accuracy, m.MCC, m.Specificity, m.NPV, m.TP, m.TN) == (1.0, 0.0, 0.0, 0.0, 3, 0)


def test_no_rows(table):
    m = E.classification_metrics(preds(table, 0, 0, 0, 0)).first()
    assert m.Accuracy == 0.0 and m.TP == 0


def test_large_margins_do_not_overflow(table):
    n = 10**12
    m = E.metrics(table([(n, n, n // 10, n // 10)], "TP long, TN long, FP long, FN long")).first()
    assert math.isclose(m.MCC, round((1 - 0.01) / 1.21, 4), abs_tol=1e-4)


def test_scores_to_basic_metrics(table):
    rows = [(1, [0.2, 0.8]), (0, [0.5, 0.5]), (1, [0.9, 0.1]), (0, [0.3, 0.7])]
    m = E.basic_metrics(table(rows, "y_true int, scores array<double>")).first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.mcc) == (0.5, 0.5, 0.5, 0.5, 0.0)


def test_baseline_delta(table, grid):
    new, old = grid.filter("run = 0"), grid.filter("run = 1")
    rows = {r.metric: (r.delta, r.verdict) for r in E.baseline_delta(old, new).collect()}
    assert rows["Accuracy"] == (0.0003, "better") and rows["Recall"] == (-0.0024, "behind")


def judged(table, rows):
    return table(rows, "y_true int, y_pred int, review string, cleaned_review string")


def test_error_analysis(table):
    rows = [(1, 1, "not good not", "good"), (0, 0, "fine", "fine day"), (1, 0, "never ever no", "ever")]
    out = {r.outcome: r for r in E.error_analysis(judged(table, rows)).collect()}
    assert (out["Correct"].n, out["Correct"].share, out["Correct"].avg_length, out["Correct"].avg_negations) == (2, 66.7, 1.5, 1.0)
    assert (out["Misclassified"].n, out["Misclassified"].avg_negations) == (1, 2.0)
    assert E.error_analysis(judged(table, rows[:2])).count() == 0


def test_histograms_use_each_groups_own_range(table):
    rows = [(1, 1, "", " ".join("w" * n)) for n in (1, 2, 11)] + [(1, 0, "", "w w w")] * 2
    out = E.error_length_histogram(judged(table, rows), bins=10).collect()
    correct = {r.bin: r.n for r in out if r.outcome == "Correct"}
    assert correct == {0: 1, 1: 1, 9: 1}
    wrong = [r for r in out if r.outcome == "Misclassified"]
    assert len(wrong) == 1 and wrong[0].bin == 5 and wrong[0].n == 2 and wrong[0].low == 3.0


def test_perfect_scores_are_flagged(table):
    rows = [("a", 0.999), ("b", 0.9989)]
    flags = {r.Model: r.suspicious for r in Q.perfect_score_flag(table(rows, "Model string, Accuracy double")).collect()}
    assert flags == {"a": True, "b": False}
