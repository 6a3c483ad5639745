import random

import pytest
from pyspark.sql import functions as F

from textmeter import resources as R
from textmeter.operators import evaluation as E, models as M
from textmeter.plans import study
from textmeter.plans.audit import integrity_audit
from textmeter.plans.transformer_data import evaluate_transformer, transformer_data
from textmeter.session import materialize

GOOD, BAD, PLAIN = ["great", "superb", "moving"], ["awful", "dull", "boring"], ["film", "plot", "actor", "scene", "score", "town"]


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        label = i % 2
        words = rng.choices(GOOD if label else BAD, k=3) + rng.choices(PLAIN, k=8)
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + ".", label))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(10)]
    return spark.createDataFrame(rows, "id long, review string, sentiment int").cache()


def test_flagship_learns(reviews):
    row = study.tfidf_regression(reviews).first()
    assert (row.Model, row.Features) == ("Logistic Regression", "TF-IDF")
    assert row.TP + row.TN + row.FP + row.FN == 32
    assert row.Accuracy > 0.9


@pytest.fixture(scope="module")
def whole(spark, reviews):
    valence = spark.createDataFrame([("great", 3.1), ("awful", -2.0)], "term string, valence double")
    polarity = spark.createDataFrame(
        [("great", 0.8, 0.75, None), ("dull", -0.3, 0.5, None)],
        "term string, polarity double, subjectivity double, intensity double")
    models = M.recipes() | {"Random Forest": lambda n: M.random_forest(n, trees=5, depth=4)}
    return study.sentiment_study(
        reviews, valence, polarity, max_features=100, word2vec_dim=8, word2vec_epochs=2, models=models,
        curve_steps=2, curve_folds=2)


def test_study_runs_every_experiment(whole):
    rows = whole.experiments.collect()
    assert [(r.Model, r.Features) for r in rows] == [
        (m, f) for f in R.FEATURE_SETS for m in ("Logistic Regression", "SVM (Linear)", "Random Forest")]
    tfidf = [r for r in rows if r.Features in ("TF-IDF", "Hybrid", "BoW") and r.Model != "Random Forest"]
    assert all(r.Accuracy > 0.9 for r in tfidf)
    assert whole.best.first()["F1-Score"] == max(r["F1-Score"] for r in rows)
    assert whole.comparisons["mcc"].count() == 3 and whole.results.columns == list(R.RESULT_COLUMNS)
    assert set(whole.comparisons) == {"mcc", "series", "grid", "stability"} and whole.comparisons["stability"].count() == 3
    assert whole.flags.filter("suspicious").count() == whole.results.filter("Accuracy >= 0.999").count()
    assert whole.confusion.filter("TP + TN + FP + FN = 32").count() == 12
    assert {k: v.count() > 0 for k, v in whole.exploration.items()} == dict.fromkeys(whole.exploration, True) and len(whole.exploration) == 5
    assert whole.prepared.count() == 160


def test_study_features(whole):
    row = whole.features.table.first()
    n = len(whole.features.terms.terms)
    assert (row.bow.size, row.tfidf.size, row.word2vec.size, row.hybrid.size) == (n, n, 8, n + 6)


def test_learning_curve_points(whole):
    curve = whole.curves["Logistic Regression", "TF-IDF"].orderBy("size").collect()
    assert [r.size for r in curve] == [6, 64]
    assert curve[1].val_mean > 0.8 and curve[1].train_mean > 0.9


def test_audit_counts_after_dedup(table):
    rows = [(1, "Good film", "good film", 1), (2, "good film!", "good film", 1), (3, "negative plot", "negative plot", 0)]
    report = {(r.check, r.item): (r.value, r.verdict) for r in integrity_audit(
        table(rows, "id long, review string, cleaned_review string, sentiment int")).collect()}
    assert report["duplicates", "raw"] == (0.0, "ok") and report["duplicates", "cleaned"] == (1.0, "removed")
    assert report["label_leakage", "negative"] == (1.0, "leaked") and report["label_leakage", "negative/neg"][0] == 1.0
    assert report["vocabulary", "size"] == (4.0, "critical")
    assert report["top_tokens", "good"][0] == 1.0
    assert report["class_balance", "ratio"] == (1.0, "ok") and report["length", "avg"] == (2.0, "short")


def test_transformer_sizes(table):
    rows = [(i, int(i % 4 == 0), "train" if i < 800 else "test") for i in range(1000)]
    df = table(rows, "id long, sentiment int, split string")

    def sizes(out):
        return {(r.split, r.sentiment): r["count"] for r in out.groupBy("split", "sentiment").count().collect()}

    balanced = sizes(transformer_data(df, 300, 50))
    assert sum(n for (s, _), n in balanced.items() if s == "val") == 50
    assert balanced["train", 0] + balanced["val", 0] == 150 and balanced["test", 1] == 25
    kept = sizes(transformer_data(df, 400, balanced=False))
    assert (kept["val", 0], kept["val", 1], kept["train", 1], kept["test", 1]) == (37, 13, 87, 50)


def test_transformer_report(table):
    scored = table([(i, int(i < 6), [0.0, 1.0] if i < 5 else [1.0, 0.0]) for i in range(10)], "id long, y_true int, scores array<double>")
    counts = table([("LR", "TF-IDF", 4, 4, 1, 1)], "Model string, Features string, TP long, TN long, FP long, FN long")
    old = E.results_table(E.metrics(counts))
    report = evaluate_transformer(scored, old, old)
    assert report.metrics.first().Accuracy == 0.9
    assert {r.metric: r.verdict for r in report.comparison.collect()}["Accuracy"] == "better"
    assert {r.Model for r in report.results.collect()} == {"LR", "DistilBERT"}
    assert report.report.count() == 5


def test_audit_of_an_empty_table_and_of_nulls(table):
    schema = "id long, review string, cleaned_review string, sentiment int"
    empty = {(r.check, r.item): r.value for r in integrity_audit(table([], schema)).collect()}
    assert empty["class_balance", "pos"] == 0.0 and empty["length", "avg"] is None and empty["vocabulary", "size"] == 0.0
    rows = [(None, None, None, None), (1, "Positive", "positive", 1), (None, "plot plot", "plot plot", 0)]
    found = {(r.check, r.item): r.value for r in integrity_audit(table(rows, schema)).collect()}
    assert found["length", "min"] == 0.0 and found["length", "max"] == 2.0 and found["length", "avg"] == 1.0
    assert found["label_leakage", "positive"] == found["label_leakage", "positive/pos"] == 1.0
    assert found["class_balance", "pos"] == found["class_balance", "neg"] == 1.0 and found["top_tokens", "plot"] == 2.0


def test_audit_scans_its_table_once(table, monkeypatch):
    from textmeter.plans import audit

    written, scans = [], []
    count = audit.Q.token_counts
    monkeypatch.setattr(audit, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(audit.Q, "token_counts", lambda df: scans.append(df.inputFiles()) or count(df))
    report = audit.integrity_audit(table([(1, "good film", "good film", 1)], "id long, review string, cleaned_review string, sentiment int"))
    assert written == ["audit", "audit-tokens"] and len(scans) == 1
    assert not {f for f in report.inputFiles()} & set(scans[0])
