"""Labelled-text analytics on Spark: quality gates, splits, cleaning,
features, classifiers, evaluation and exploratory tables, each a function
from DataFrame to DataFrame."""
