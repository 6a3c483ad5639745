"""The whole study: gates, split, cleaning, audit, features, experiments, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame

from textmeter import resources as R
from textmeter.operators import eda, evaluation as E, features as V, models as M, quality as Q
from textmeter.operators.cleaning import clean_text
from textmeter.operators.splits import split_balance, stratified_split
from textmeter.plans.audit import integrity_audit
from textmeter.session import materialize


def prepare(reviews: DataFrame, lemmas: DataFrame | None = None, seed: int = R.SEED) -> DataFrame:
    """Deduplicated, split on the raw texts, then cleaned; written once."""
    Q.require_columns(reviews, ("id", "review", "sentiment"))
    # Two narrow passes choose the split; what they read is the deduplicated table, not the joins before it.
    unique = materialize(Q.dedup(reviews).select("id", "review", "sentiment"), "unique")
    return materialize(clean_text(stratified_split(unique, seed=seed), lemmas), "prepared")


def tfidf_regression(reviews: DataFrame, max_features: int = R.MAX_FEATURES, lemmas: DataFrame | None = None) -> DataFrame:
    """One experiment end to end: TF-IDF with logistic regression, as one row of metrics."""
    termed = V.with_terms(prepare(reviews, lemmas))
    train = termed.filter("split = 'train'")
    terms = V.fit_terms(train, max_features)
    table = V.tfidf_vectors(V.count_vectors(termed, terms), terms)
    grid = M.experiment_grid(table, {"TF-IDF": "tfidf"}, {"Logistic Regression": M.logistic_regression})
    return grid.drop("run")


# Which experiments get a learning curve.
CURVES = (("Logistic Regression", "TF-IDF"), ("Random Forest", "BoW"))


@dataclass
class Study:
    """A study's tables. Features and experiments exist; each report is made when it is asked for."""

    prepared: DataFrame
    features: V.FeatureSets
    experiments: DataFrame
    fitted: dict[tuple[str, str], Model]
    models: dict[str, M.Recipe]
    curve_steps: int = 8
    curve_folds: int = 5

    # --- data ---

    @property
    def balance(self) -> DataFrame:
        return split_balance(self.prepared)

    @property
    def summary(self) -> DataFrame:
        return eda.dataset_summary(self.prepared)

    @property
    def audit(self) -> DataFrame:
        return integrity_audit(self.prepared)

    @property
    def exploration(self) -> dict[str, DataFrame]:
        """The tables behind the exploratory plots."""
        p = self.prepared
        return {
            "class_distribution": eda.class_distribution(p),
            "length_histogram": eda.length_histogram(p),
            "top_words": eda.top_words(p, text="cleaned_review"),
            "word_cloud": eda.word_cloud_weights(p, stop_words=R.ENGLISH_STOP_WORDS, collocations=True),
            "length_boxplot": eda.length_boxplot(p),
        }

    # --- experiments ---

    @property
    def results(self) -> DataFrame:
        return E.results_table(self.experiments)

    @property
    def best(self) -> DataFrame:
        return E.best_experiment(self.experiments, "run")

    @property
    def flags(self) -> DataFrame:
        """Experiments too good to be true, marked."""
        return Q.perfect_score_flag(self.results)

    @property
    def confusion(self) -> DataFrame:
        """The four counts of each experiment."""
        return self.experiments.select("run", "Model", "Features", *R.COUNT_METRICS)

    @property
    def comparisons(self) -> dict[str, DataFrame]:
        """Experiments side by side: by metric, by model and feature set, and how steady each model is."""
        r = self.results
        return {"mcc": E.mcc_matrix(r), "series": E.metric_series(r), "grid": E.metric_grid(r), "stability": E.stability_by_model(r)}

    @property
    def errors(self) -> dict[str, DataFrame]:
        """Error analysis of the models that were kept."""
        test = self.features.table.filter("split = 'test'")
        return {name: E.error_analysis(M.predict(model, test)) for (name, _), model in self.fitted.items()}

    @property
    def error_lengths(self) -> dict[str, DataFrame]:
        test = self.features.table.filter("split = 'test'")
        return {name: E.error_length_histogram(M.predict(model, test)) for (name, _), model in self.fitted.items()}

    @property
    def curves(self) -> dict[tuple[str, str], DataFrame]:
        train = self.features.table.filter("split = 'train'")
        return {
            (name, feature): M.learning_curve(train, self.features.columns[feature], self.models[name], self.curve_steps, self.curve_folds)
            for name, feature in CURVES if name in self.models and self.curve_steps
        }


def sentiment_study(reviews: DataFrame, valence: DataFrame, polarity: DataFrame, lemmas: DataFrame | None = None,
                    max_features: int = R.MAX_FEATURES, word2vec_dim: int = R.WORD2VEC_DIM,
                    word2vec_epochs: int = R.WORD2VEC_EPOCHS, models: dict[str, M.Recipe] | None = None,
                    curve_steps: int = 8, curve_folds: int = 5, **lexicon_rules) -> Study:
    """Run every model on every feature set: 12 experiments by default. Reports are tables of the study."""
    models = M.recipes() if models is None else models
    prepared = prepare(reviews, lemmas)
    sets = V.all_feature_sets(
        prepared, valence, polarity, max_features, word2vec_dim, word2vec_epochs, **lexicon_rules
    )
    fitted = {}
    experiments = M.experiment_grid(sets.table, sets.columns, models, fitted=fitted, keep=("TF-IDF",))
    return Study(prepared, sets, experiments, fitted, models, curve_steps, curve_folds)
