"""Registered queries: operator name -> callable(spark, folder of parquet tables) -> DataFrame.

Roles of the test tables: ``reviews`` is documents joined with their labels
(label = quality); predictions are 1 - toxic; an experiment is one source
(as model) in one language (as feature set).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textmeter import resources as R
from textmeter.catalog import words as N
from textmeter.functions import text as X
from textmeter.operators import (
    cleaning as C, eda, evaluation as E, features as V, lexicon as L, models as M, quality as Q, splits as S,
)
from textmeter.plans import study
from textmeter.plans.audit import integrity_audit
from textmeter.plans.transformer_data import evaluate_transformer, transformer_data
from textmeter.session import fresh_path, materialize, spread
from textmeter.sources import models as model_files, tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- roles -------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reviews(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("sentiment"))
    return documents(spark, sf).join(labels, "id")


def documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("review"))
    return spread(docs, "id")


def pages(spark, sf):
    html = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("review"))
    return spread(html, "id")


def cleaned(spark, sf):
    return C.clean_text(reviews(spark, sf))


def predictions(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred")
    )


def scored(spark, sf):
    """Predictions as per-class scores."""
    p = predictions(spark, sf)
    per_class = F.array((1 - F.col("y_pred")).cast("double"), F.col("y_pred").cast("double"))
    return p.select("id", "y_true", per_class.alias("scores"))


def experiments(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("Model"), F.col("lang").alias("Features")
    )
    return E.classification_metrics(predictions(spark, sf).join(docs, "id"), ("Model", "Features"))


def split_reviews(spark, sf):
    return S.stratified_split(reviews(spark, sf))


def split_cleaned(spark, sf):
    return C.clean_text(split_reviews(spark, sf))


def split_terms(spark, sf):
    """Terms of the split, cleaned texts: made once, read by every fit and transform."""
    return materialize(V.with_terms(split_cleaned(spark, sf)).select("id", "sentiment", "split", "terms"), "terms")


def fitted(spark, sf):
    termed = split_terms(spark, sf)
    return termed, V.fit_terms(termed.filter("split = 'train'"))


def tfidf_table(spark, sf):
    termed, model = fitted(spark, sf)
    return V.tfidf_vectors(V.count_vectors(termed, model), model), model


LEXICON_RULES = {"boosters": N.BOOSTERS, "negators": N.NEGATORS, "polarity_negators": N.POLARITY_NEGATORS}


def valence_lexicon(spark):
    return spark.createDataFrame(list(N.VALENCE), "term string, valence double")


def polarity_lexicon(spark):
    return spark.createDataFrame(list(N.POLARITY), "term string, polarity double, subjectivity double, intensity double")


def word_vectors(spark, sf):
    """The most frequent document words, each with one row of the embeddings table."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    counts = Q.token_counts(documents(spark, sf).select(X.array_text(X.clean_tokens(F.col("review"))).alias("cleaned_review")))
    stats = materialize(counts.select(F.col("token").alias("term"), F.col("n").alias("tf")), "words")
    top = V.top_terms(stats, vectors.count())
    # Places in the order (tf falling, term): words of one tf and first letters are numbered among
    # themselves, after all words before them. Only one row per such group is summed up in order.
    grouped = top.withColumn("start", F.substring("term", 1, 2))
    sizes = grouped.groupBy("tf", "start").agg(F.count("*").alias("n"))
    order = W.orderBy(F.desc("tf"), "start")
    begins = sizes.select("tf", "start", (F.sum("n").over(order) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("tf", "start").orderBy("term"))
    numbered = grouped.withColumn("at", inside).join(begins, ["tf", "start"]).select(
        "term", (F.col("before") + F.col("at") - 1).cast("bigint").alias("position")
    )
    return numbered.join(vectors, "position").select(F.col("term").alias("word"), "vector")


# --- sources and sinks -------------------------------------------------------

@query
def csv_source(spark, sf):
    path = T.write_csv(reviews(spark, sf), fresh_path(spark, "reviews"))
    return T.read_csv(spark, path)


@query
def union_splits_source(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"), "toxic")
    stored = fresh_path(spark, "splits")
    docs.join(labels, "id").write.partitionBy("toxic").parquet(stored)
    whole = spark.read.parquet(stored)
    marked = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return T.union_splits(whole.filter(marked), whole.filter(~marked))


@query
def seeded_shuffle(spark, sf):
    return S.seeded_shuffle(reviews(spark, sf)).select("id", "position")


@query
def require_columns(spark, sf):
    return Q.column_report(Q.require_columns(reviews(spark, sf)))


@query
def csv_sink(spark, sf):
    results = E.results_table(experiments(spark, sf))
    path = T.write_csv(results, fresh_path(spark, "results"))
    return T.read_csv(spark, path, results.schema)


@query
def cleaned_cache(spark, sf):
    raw, path = reviews(spark, sf), fresh_path(spark, "cleaned")
    T.cleaned_cache(raw, path, C.clean_text)
    return T.cleaned_cache(raw, path, C.clean_text).select("id", "sentiment", "cleaned_review")


@query
def results_upsert(spark, sf):
    rows = E.results_table(experiments(spark, sf))
    replacement = E.classification_metrics(predictions(spark, sf)).select(
        F.lit("src0").alias("Model"), F.lit("all").alias("Features"), "*"
    )
    path = fresh_path(spark, "results")
    T.store_results(path, rows)
    return T.store_results(path, E.results_table(replacement))


@query
def model_store(spark, sf):
    """Whether a stored model predicts like the one it was made from, per test row."""
    scored_table, _ = tfidf_table(spark, sf)
    train, test = scored_table.filter("split = 'train'"), scored_table.filter("split = 'test'")
    model, before = M.train_and_predict(M.logistic_regression, train, test, "tfidf")
    path = model_files.save_model(model, fresh_path(spark, "model"))
    after = M.predict(model_files.load_model(path), test)
    both = before.select("id", F.col("y_pred").alias("saved")).join(after.select("id", F.col("y_pred").alias("loaded")), "id")
    return both.select("id", (F.col("saved") == F.col("loaded")).alias("same"))


# --- quality gates -----------------------------------------------------------

@query
def realism_gate(spark, sf):
    return Q.realism_gate(documents(spark, sf), min_rows=100, min_avg_words=50, min_vocabulary=5_000)


@query
def uniform_sample(spark, sf):
    return S.uniform_sample(documents(spark, sf), 100).select("id", "review")


@query
def dedup_exact(spark, sf):
    return Q.dedup(documents(spark, sf))


@query
def dup_counts(spark, sf):
    return Q.dup_counts(C.clean_text(documents(spark, sf)))


@query
def dedup_cleaned(spark, sf):
    return Q.dedup_cleaned(C.clean_text(documents(spark, sf))).select("id", "cleaned_review")


@query
def label_leakage(spark, sf):
    return Q.label_leakage(cleaned(spark, sf), N.LEAKAGE)


@query
def vocab_sanity(spark, sf):
    return Q.vocab_sanity(cleaned(spark, sf))


@query
def top_tokens_corpus(spark, sf):
    return Q.top_tokens(cleaned(spark, sf))


@query
def length_audit(spark, sf):
    return Q.length_audit(cleaned(spark, sf))


@query
def class_balance(spark, sf):
    return Q.class_balance(reviews(spark, sf))


@query
def perfect_score_flag(spark, sf):
    return Q.perfect_score_flag(experiments(spark, sf)).select("Model", "Features", "Accuracy", "suspicious")


@query
def split_leakage(spark, sf):
    return Q.split_leakage(split_cleaned(spark, sf))


# --- splits and sampling -----------------------------------------------------

@query
def stratified_split(spark, sf):
    return split_reviews(spark, sf).select("id", "sentiment", "split")


@query
def split_balance(spark, sf):
    return S.split_balance(split_reviews(spark, sf))


@query
def balanced_sample(spark, sf):
    return S.balanced_sample(reviews(spark, sf), 80).select("id", "sentiment")


@query
def proportional_sample(spark, sf):
    return S.proportional_sample(reviews(spark, sf), 101).select("id", "sentiment")


@query
def tail_validation_split(spark, sf):
    return S.tail_validation_split(reviews(spark, sf)).select("id", "split")


@query
def stratified_validation_split(spark, sf):
    return S.stratified_validation_split(reviews(spark, sf)).select("id", "sentiment", "split")


@query
def bootstrap_resample(spark, sf):
    return S.bootstrap_resample(reviews(spark, sf), 200).select("id", "sentiment", "draw")


@query
def stratified_kfold(spark, sf):
    return S.stratified_kfold(reviews(spark, sf)).select("id", "sentiment", "fold")


# --- text scalars ------------------------------------------------------------

def _scalar(df: DataFrame, value, name: str = "result") -> DataFrame:
    return df.select("id", value(F.col("review")).alias(name))


def planted(spark, sf):
    text = F.col("review")
    for old, new in N.PLANTED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return documents(spark, sf).select("id", text.alias("review"))


def _normalised(text):
    return X.normalize_whitespace(X.strip_special(X.lowercase(text)))


@query
def strip_html(spark, sf):
    return _scalar(pages(spark, sf), X.strip_html)


@query
def strip_urls(spark, sf):
    return _scalar(pages(spark, sf), X.strip_urls)


@query
def expand_contractions(spark, sf):
    return _scalar(planted(spark, sf), X.expand_contractions)


@query
def lowercase(spark, sf):
    return _scalar(documents(spark, sf), X.lowercase)


@query
def strip_special(spark, sf):
    return _scalar(documents(spark, sf), X.strip_special)


@query
def normalize_whitespace(spark, sf):
    return _scalar(documents(spark, sf), X.normalize_whitespace)


@query
def tokenize(spark, sf):
    tokens = planted(spark, sf).select("id", X.tokenize(_normalised(F.col("review"))).alias("_t"))
    return tokens.select("id", F.posexplode_outer("_t").alias("pos", "token")).filter("token IS NOT NULL")


@query
def remove_stopwords(spark, sf):
    return _scalar(documents(spark, sf), lambda t: X.array_text(X.remove_stop_words(X.tokenize(_normalised(t)))))


@query
def min_token_length(spark, sf):
    return _scalar(documents(spark, sf), lambda t: X.array_text(X.min_token_length(X.tokenize(_normalised(t)))))


@query
def lemmatize(spark, sf):
    tokens = documents(spark, sf).select("id", X.clean_tokens(F.col("review")).alias("tokens"))
    # The lemma table is a resource: built once, then looked up.
    words = tokens.select(F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    counts = materialize(words.groupBy("token").count(), "words")
    nouns = counts.filter("count >= 3").select(F.col("token").alias("term"))
    lemmas = materialize(C.lemma_table(counts, nouns), "lemmas")
    return C.lemmatize(tokens, lemmas).select("id", X.array_text(F.col("tokens")).alias("result"))


@query
def clean_text(spark, sf):
    whole = pages(spark, sf).withColumn("kind", F.lit("page")).unionByName(
        planted(spark, sf).withColumn("kind", F.lit("document"))
    )
    return C.clean_text(whole).select("kind", "id", "cleaned_review")


@query
def word_count(spark, sf):
    return _scalar(documents(spark, sf), X.word_count)


@query
def negation_count(spark, sf):
    return _scalar(planted(spark, sf), X.negation_count)


@query
def label_name(spark, sf):
    return reviews(spark, sf).select("id", X.label_name(F.col("sentiment")).alias("result"))


@query
def text_preview(spark, sf):
    clean = X.array_text(X.clean_tokens(F.col("review")))
    return documents(spark, sf).select(
        "id", X.text_preview(F.col("review")).alias("result"), X.text_preview(clean, 100).alias("cleaned")
    )


# --- features ----------------------------------------------------------------

@query
def ngrams_1_2(spark, sf):
    terms = split_terms(spark, sf).select("id", F.explode_outer("terms").alias("term"))
    return terms.filter("term IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("n"))


@query
def bow_vocabulary(spark, sf):
    return V.vocabulary(split_terms(spark, sf).filter("split = 'train'"))


@query
def bow_transform(spark, sf):
    termed, model = fitted(spark, sf)
    counts = V.entries(V.count_vectors(termed, model), "bow", value="n")
    return counts.select("id", "idx", F.col("n").cast("bigint").alias("n"))


@query
def idf_fit(spark, sf):
    idf = V.idf_table(split_terms(spark, sf).filter("split = 'train'"))
    return idf.select("term", "idx", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_transform(spark, sf):
    vectors, _ = tfidf_table(spark, sf)
    return V.entries(vectors, "tfidf").select("id", "idx", F.round("weight", 6).alias("weight"))


@query
def feature_shape(spark, sf):
    vectors, model = tfidf_table(spark, sf)
    train = V.feature_shape(vectors.filter("split = 'train'"), "tfidf", len(model.terms))
    test = V.feature_shape(vectors.filter("split = 'test'"), "tfidf", len(model.terms))
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query
def tfidf_top_tokens(spark, sf):
    vectors, model = tfidf_table(spark, sf)
    return V.top_weighted_terms(vectors.filter("split = 'train'"), "tfidf", model)


@query
def word2vec_fit(spark, sf):
    train = materialize(split_cleaned(spark, sf).filter("split = 'train'").select("tokens"), "tokens")
    vectors = V.fit_word2vec(train).getVectors()
    return vectors.select("word", F.size(F.unwrap_udt("vector").getField("values")).alias("dim"))


@query
def word2vec_doc_vectors(spark, sf):
    means = V.mean_vectors(cleaned(spark, sf), word_vectors(spark, sf))
    return means.select("id", F.posexplode("mean").alias("dim", "v")).select("id", "dim", F.round("v", 6).alias("value"))


@query
def lexicon_valence(spark, sf):
    return L.valence_scores(documents(spark, sf), valence_lexicon(spark), N.BOOSTERS, N.NEGATORS)


@query
def lexicon_polarity(spark, sf):
    scores = L.polarity_scores(documents(spark, sf), polarity_lexicon(spark), N.POLARITY_NEGATORS)
    return scores.select("id", F.round("polarity", 10).alias("polarity"), F.round("subjectivity", 10).alias("subjectivity"))


@query
def hybrid_features(spark, sf):
    vectors, _ = tfidf_table(spark, sf)
    scores = L.lexicon_scores(reviews(spark, sf), valence_lexicon(spark), polarity_lexicon(spark), **LEXICON_RULES)
    weights = V.entries(V.hybrid_vectors(vectors, scores), "hybrid").select("id", "idx", F.round("weight", 8).alias("weight"))
    return weights.filter("weight <> 0")


def _size(vector: str):
    """Length of a vector, sparse or dense."""
    opened = F.unwrap_udt(F.col(vector))
    return F.coalesce(opened.getField("size"), F.size(opened.getField("values"))).cast("bigint")


@query
def all_feature_sets(spark, sf):
    sets = V.all_feature_sets(
        materialize(split_cleaned(spark, sf), "cleaned"), valence_lexicon(spark), polarity_lexicon(spark), **LEXICON_RULES
    )
    return sets.table.select("id", "split", *[_size(c).alias(c) for c in sets.columns.values()])


# --- models ------------------------------------------------------------------

def _intercept_is_optimal(model, train) -> bool:
    """Regression: the mean of the predicted chances is the share of positives where the loss is least."""
    chance = vector_to_array("probability")[1]
    gap = model.transform(train).agg(F.avg(chance) - F.avg("sentiment")).first()[0]
    return abs(gap) < 1e-2


def _hinge_is_optimal(model, train) -> bool:
    """SVM: where the sum of loss and penalty is least, the bias and the weights follow from the rows inside the margin.

    Then b = 2 * sum(y * gap) and w.w = 2 * sum(y * gap * w.x), gap = max(0, 1 - y * (w.x + b)), with C = 1.
    """
    side, score = 2 * F.col("sentiment") - 1, vector_to_array("rawPrediction")[1]
    pull = side * F.greatest(1 - side * score, F.lit(0.0))
    b, w = model.intercept, model.coefficients.toArray()
    by_bias, by_weights = model.transform(train).agg(2 * F.sum(pull), 2 * F.sum(pull * (score - b))).first()
    return abs(b - by_bias) < 1e-2 * (1 + abs(b)) and abs(w @ w - by_weights) < 1e-2 * (w @ w)


def _model_query(recipe, sound=None):
    """(id, y_true, sound) of the test rows: the model meets its condition and is no worse in training than the larger class."""
    def run(spark, sf):
        vectors, _ = tfidf_table(spark, sf)
        train, test = vectors.filter("split = 'train'"), vectors.filter("split = 'test'")
        model, preds = M.train_and_predict(recipe, train, test, "tfidf")
        seen = M.predict(model, train).agg(
            F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("right"), F.avg("y_true").alias("share")
        ).first()
        good = seen.right >= max(seen.share, 1 - seen.share) - 1e-9 and (sound is None or sound(model, train))
        return preds.select("id", "y_true", F.lit(good).alias("sound"))
    return run


QUERIES["logistic_regression"] = _model_query(M.logistic_regression, _intercept_is_optimal)
QUERIES["linear_svm"] = _model_query(M.linear_svm, _hinge_is_optimal)
QUERIES["random_forest"] = _model_query(M.random_forest)


def _confirmed(experiments: DataFrame, *names: str) -> DataFrame:
    """Test rows of either class, from the four counts, and whether the ratios follow from these."""
    def near(metric, part, whole):
        ratio = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        return F.abs(F.col(f"`{metric}`") - ratio) < 1e-4

    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    follows = near("Accuracy", tp + tn, tp + tn + fp + fn) & near("Precision", tp, tp + fp) & near("Recall", tp, tp + fn)
    follows &= near("Specificity", tn, tn + fp) & near("NPV", tn, tn + fn) & near("F1-Score", 2 * tp, 2 * tp + fp + fn)
    return experiments.select(*names, (tp + fn).alias("positives"), (tn + fp).alias("negatives"), follows.alias("follows"))


@query
def train_and_predict(spark, sf):
    termed, model = fitted(spark, sf)
    rows = V.count_vectors(termed, model)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    _, preds = M.train_and_predict(M.logistic_regression, train, test, "bow")
    return _confirmed(E.classification_metrics(preds))


@query
def experiment_grid(spark, sf):
    """All classifiers on all feature sets."""
    sets = V.all_feature_sets(
        materialize(split_cleaned(spark, sf), "cleaned"), valence_lexicon(spark), polarity_lexicon(spark), **LEXICON_RULES
    )
    return _confirmed(M.experiment_grid(sets.table, sets.columns), "run", "Model", "Features")


@query
def learning_curve(spark, sf):
    vectors, _ = tfidf_table(spark, sf)
    curve = M.learning_curve(vectors.filter("split = 'train'"), "tfidf", M.logistic_regression)
    shares = [F.col(c).between(0, 1) for c in ("train_mean", "val_mean", "train_std", "val_std")]
    return curve.select("size", (shares[0] & shares[1] & shares[2] & shares[3]).alias("bounded"))


@query
def argmax_prediction(spark, sf):
    scores = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("scores")
    )
    return M.argmax_prediction(scores).select("id", "y_pred")


# --- evaluation --------------------------------------------------------------

@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(predictions(spark, sf))


@query
def classification_metrics(spark, sf):
    return E.classification_metrics(predictions(spark, sf))


@query
def basic_metrics(spark, sf):
    return E.basic_metrics(scored(spark, sf))


@query
def classification_report(spark, sf):
    return E.classification_report(predictions(spark, sf))


@query
def results_table(spark, sf):
    return E.results_table(experiments(spark, sf))


@query
def best_experiment(spark, sf):
    return E.best_experiment(E.results_table(experiments(spark, sf)))


@query
def mcc_matrix(spark, sf):
    return E.mcc_matrix(experiments(spark, sf))


@query
def metric_series(spark, sf):
    return E.metric_series(experiments(spark, sf))


@query
def metric_grid(spark, sf):
    return E.metric_grid(experiments(spark, sf))


@query
def stability_by_model(spark, sf):
    return E.stability_by_model(experiments(spark, sf))


@query
def baseline_delta(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    preds = predictions(spark, sf).join(docs, "id")
    return E.baseline_delta(
        E.classification_metrics(preds.filter("lang = 'en'")), E.classification_metrics(preds.filter("lang <> 'en'"))
    )


def judged(spark, sf):
    return cleaned(spark, sf).join(predictions(spark, sf), "id")


@query
def error_analysis(spark, sf):
    return E.error_analysis(judged(spark, sf))


@query
def error_length_histogram(spark, sf):
    return E.error_length_histogram(judged(spark, sf))


# --- exploratory tables ------------------------------------------------------

@query
def class_distribution(spark, sf):
    return eda.class_distribution(reviews(spark, sf))


@query
def length_histogram(spark, sf):
    return eda.length_histogram(reviews(spark, sf))


@query
def top_words(spark, sf):
    return eda.top_words(reviews(spark, sf))


@query
def word_cloud_weights(spark, sf):
    return eda.word_cloud_weights(reviews(spark, sf), stop_words=R.ENGLISH_STOP_WORDS)


@query
def word_cloud_collocations(spark, sf):
    return eda.word_cloud_weights(reviews(spark, sf), stop_words=R.ENGLISH_STOP_WORDS, collocations=True)


@query
def length_boxplot(spark, sf):
    return eda.length_boxplot(reviews(spark, sf))


@query
def dataset_summary(spark, sf):
    return eda.dataset_summary(reviews(spark, sf))


# --- plans -------------------------------------------------------------------

QUERIES["integrity_audit"] = lambda spark, sf: integrity_audit(cleaned(spark, sf), N.LEAKAGE)


@query
def sentiment_study(spark, sf):
    """The whole grid from raw reviews on: each experiment of the results table, with its counts."""
    made = study.sentiment_study(reviews(spark, sf), valence_lexicon(spark), polarity_lexicon(spark), **LEXICON_RULES)
    rows = made.results.select("Model", "Features").join(made.experiments, ["Model", "Features"])
    return _confirmed(rows, "run", "Model", "Features")


@query
def tfidf_regression(spark, sf):
    """One experiment from raw reviews to its row of metrics."""
    return _confirmed(study.tfidf_regression(reviews(spark, sf)), "Model", "Features")


@query
def transformer_data_prep(spark, sf):
    parts = transformer_data(split_reviews(spark, sf), train_size=90, test_size=20)
    return parts.select("id", "sentiment", "split")


@query
def transformer_evaluation(spark, sf):
    results = E.results_table(experiments(spark, sf))
    report = evaluate_transformer(scored(spark, sf), E.best_experiment(results), results)
    return report.comparison
