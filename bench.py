"""Time the headline queries and print one JSON line.

Each query runs to completion into a sink that discards its rows, so the
figures are the engine's work, not the transfer of results to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textmeter.catalog.queries import QUERIES  # noqa: E402
from textmeter.session import local_session, remove_written  # noqa: E402

HEADLINE = (
    # sources and gates
    "csv_source", "dedup_exact", "dup_counts", "realism_gate", "label_leakage", "vocab_sanity", "integrity_audit",
    # splits
    "stratified_split", "stratified_kfold", "bootstrap_resample", "split_leakage",
    # text
    "expand_contractions", "clean_text", "tokenize", "lemmatize", "word_count", "negation_count",
    # features
    "bow_vocabulary", "bow_transform", "tfidf_transform", "tfidf_top_tokens", "word2vec_fit", "word2vec_doc_vectors",
    "lexicon_valence", "lexicon_polarity", "hybrid_features", "all_feature_sets",
    # models
    "logistic_regression", "linear_svm", "random_forest", "train_and_predict", "model_store", "tfidf_regression",
    # evaluation and exploration
    "classification_metrics", "mcc_matrix", "error_analysis", "top_words", "word_cloud_collocations",
    "length_histogram", "length_boxplot", "dataset_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "textmeter-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the JVM's threads and code paths that every query shares.
    QUERIES["class_balance"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_written(spark)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
